"""A quality classifier by co-training.

Two views of a document are classified apart: the text's content (kinds of characters, word shapes, repetition and which
words there are) and the page's metadata (language, source, stated length), which never looks at the text. Both start
from a bounded sample of labelled documents, a third of which is held out. In each round either view labels those of all
other documents that it is most sure of, by log-odds calibrated on the documents held out, and hands them to the other
to learn from; a view that tells little hands over little. The features of all documents are kept once, in blocks; how
sure a view must be follows from counts over them, and models are fitted from sums of gradients and Hessians over them,
so nothing of the corpus comes to the driver. Which documents were handed over follows from the models and cuts of the
rounds before, so no state is kept. In the end the two views are combined on the documents held out, and all documents
are scored in one pass over the blocks.

Defined results: null text counts as empty; null language, source or length are values of their own; labels with a null
quality are left out; without labels of both kinds every document scores 1 and is kept; where the labels held out are
not of both kinds, all labelled documents calibrate; repeated rows score alike; other columns are kept.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import durable, each_batch, table

#: Most labelled documents that training looks at. They are those with the least hashes of their ids.
LABELLED = 6000
ROUNDS = 4
#: Steps of a round towards the best fit, each one job; the models of the round before are the start.
STEPS = 4
#: Share of the documents without a training label that a view hands over per round, and how sure it must be.
HANDED, SURE = 0.05, 0.95
#: Documents scoring below are rejected.
KEEP = 0.5
ADDED = ["content_score", "metadata_score", "score"]
#: Hashed features: of words in the content, and of language and source in the metadata.
WORDS, BUCKETS = 64, 24
#: Words whose bucket a worker keeps.
CACHE = 100_000
#: Log-odds that count as sure are counted in so many bins, up to the most there are.
BINS, MOST = 1024, 30.0

#: What each character is, by bits: a letter, a capital, a digit, a symbol, one of ! | and one that ends a sentence.
_kinds: list[np.ndarray] = []
_word_bucket: dict[str, int] = {}


def _character_kinds() -> np.ndarray:
    if not _kinds:
        is_a = lambda test: np.fromiter(map(test, map(chr, range(0x110000))), np.uint8, 0x110000)
        plain = set(".,;:!?'\"()-_")
        symbol = is_a(lambda c: not (c.isalnum() or c.isspace() or c in plain))
        _kinds.append(is_a(str.isalpha) | is_a(str.isupper) << 1 | is_a(str.isdigit) << 2 | symbol << 3 | is_a(lambda c: c in "!|") << 4 | is_a(lambda c: c in ".?") << 5)
    return _kinds[0]


def _bucket(word: str) -> int:
    at = _word_bucket.get(word)
    if at is None:
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        if len(_word_bucket) < CACHE:
            _word_bucket[word] = at
    return at


def text_view(text: str) -> list[float]:
    """Content features: shares of characters and words, so that the length has no part in them."""
    words, n = text.split(), max(1, len(text))
    total = max(1, len(words))
    kinds = np.bincount(_character_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=64)
    letters, capitals, digits, symbols, marks, ends = (int(kinds[[k for k in range(64) if k >> bit & 1]].sum()) for bit in range(6))
    letters = max(1, letters)
    counts = Counter([w.lower().strip(".,;:!?") for w in words])
    lexical = [0] * WORDS
    for word, times in counts.items():
        lexical[_bucket(word)] += times
    return [
        capitals / letters,
        letters / n,
        digits / n,
        symbols / total,
        marks / total,
        ends / total,
        sum([w.isupper() and len(w) > 1 for w in words]) / total,
        sum([not w[-1].isalnum() for w in words]) / total,
        min(30.0, sum(map(len, words)) / total) / 10,
        len(counts) / total**0.75,
        max(counts.values(), default=0) / total,
        sum(map(str.__eq__, words, words[1:])) / total,
        math.log1p(total) * len(counts) / total,
        sum([c for c in counts.values() if c > 2]) / total,
        len(set(zip(words, words[1:], words[2:]))) / max(1, total - 2),
        *[math.sqrt(x / total) for x in lexical],
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Metadata features: language, source and stated length."""
    hashed = [0.0] * BUCKETS
    for value in (f"lang {lang}", f"source {source}"):
        hashed[zlib.crc32(value.encode()) % BUCKETS] += 1.0
    size = math.log1p(max(0, n_chars or 0))
    return [*hashed, float(n_chars is None), size, size * size / 10]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([text_view(t or "") for t in batch.column("text").to_pylist()])
    return content, np.array([metadata_view(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)])


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -MOST, MOST)))


class Logistic:
    """Regularised logistic regression on features standardised by a given mean and scale. A step minimises the tangent
    quadratic bound of the loss, so it never raises the loss, however wrong the model was about a row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mean: np.ndarray | None = None, scale: np.ndarray | None = None, strength: float = 1.0):
        self.mean = x.mean(0) if mean is None else mean
        self.scale = x.std(0) + 1e-6 if scale is None else scale
        self.w, self.ridge = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, strength)
        self.ridge[0] = 1e-3
        for _ in range(100):
            step = self.step(self.parts(x, y))
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break

    def _odds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])
        return z, z @ self.w

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._odds(x)[1], -MOST, MOST)

    def parts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound's Hessian and the gradient of the loss of some rows, in one array; those of more rows add up."""
        z, odds = self._odds(x)
        far = np.maximum(np.abs(odds), 1e-4)
        return np.concatenate([((z * (np.tanh(far / 2) / (2 * far))[:, None]).T @ z).ravel(), z.T @ (_sigmoid(odds) - y)])

    def step(self, parts: np.ndarray) -> np.ndarray:
        n = len(self.w)
        return np.linalg.solve(parts[: n * n].reshape(n, n) + np.diag(self.ridge), parts[n * n :] + self.ridge * self.w)

    def copy(self) -> Logistic:
        new = Logistic.__new__(Logistic)
        new.mean, new.scale, new.ridge, new.w = self.mean, self.scale, self.ridge, self.w.copy()
        return new


class Calibrated:
    """A view's model, and what turns its log-odds into those that rows it has not learnt from bear out."""

    def __init__(self, model: Logistic, x: np.ndarray, y: np.ndarray):
        self.model = model
        self.calibration = Logistic(model.log_odds(x)[:, None], y)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.log_odds(self.model.log_odds(x)[:, None])


def body_of() -> Column:
    """A hash of what the views read, which tells rows of one doc_id apart."""
    return F.xxhash64("lang", "source", F.col("n_chars").cast("long"), "text")


def features(docs: DataFrame) -> DataFrame:
    """ids, bodies, content and metadata (both views as bytes) of all documents, in blocks; kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            if batch.num_rows:
                keys = [pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "body")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([v.tobytes()], pa.binary()) for v in _views(batch))], ["ids", "bodies", "content", "metadata"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_of().alias("body"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "text")
    return durable(docs.mapInArrow(run, "ids array<long>, bodies array<long>, content binary, metadata binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, tuple[np.ndarray, np.ndarray]]]:
    """The ids (None where null), bodies and views of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids")[k].as_py()
            yield ids, batch.column("bodies")[k].as_py(), tuple(np.frombuffer(batch.column(c)[k].as_py()).reshape(len(ids), -1) for c in ("content", "metadata"))


def _summed(blocks: DataFrame, of) -> dict[int, np.ndarray]:
    """The sums over all blocks of the arrays that `of` gives by key for the ids and views of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for ids, _, views in _blocks(batches):
            for key, values in of(ids, views).items():
                sums[key] = sums.get(key, 0) + values
        rows = [(k, at, float(v)) for k, values in sums.items() for at, v in enumerate(values) if v or at == len(values) - 1]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["key", "at", "value"])

    rows = blocks.mapInArrow(run, "key int, at int, value double").groupBy("key", "at").agg(F.sum("value").alias("value")).collect()  # as many as there are sums
    found: dict[int, np.ndarray] = {}
    for key in {r["key"] for r in rows}:
        own = [r for r in rows if r["key"] == key]
        found[key] = np.zeros(1 + max(r["at"] for r in own))
        for r in own:
            found[key][r["at"]] = r["value"]
    return found


def moments(blocks: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of the features of either view over all documents."""
    sums = _summed(blocks, lambda ids, views: {k: np.concatenate([v.sum(0), (v * v).sum(0), [len(v)]]) for k, v in enumerate(views)})
    out = []
    for k in range(2):
        total = sums[k]
        half = len(total) // 2
        mean = total[:half] / total[-1]
        out.append((mean, np.sqrt(np.maximum(0, total[half:-1] / total[-1] - mean**2)) + 1e-6))
    return out


class Pool:
    """The documents without a training label."""

    def __init__(self, blocks: DataFrame, labelled: np.ndarray):
        self.blocks, self.labelled = blocks, np.sort(labelled)
        #: of each round: the models, and for each view and label the bin and share of it that are still handed over.
        self.steps: list[tuple[list[Calibrated], dict]] = []

    def total(self, of) -> dict[int, np.ndarray]:
        """Sums of what `of` gives for the views of these documents and the labels handed to the views (nan: none)."""
        steps, labelled = list(self.steps), self.labelled

        def part(ids: list, views: tuple) -> dict[int, np.ndarray]:
            known = np.array([0 if i is None else i for i in ids], np.int64)
            free = np.array([i is None for i in ids]) | ~np.isin(known, labelled)
            views = tuple(v[free] for v in views)
            return of(views, handed(views, dealt(known[free]), steps))

        return _summed(self.blocks, part)


def dealt(ids: np.ndarray) -> np.ndarray:
    """A number from 0 up to 1 for each id."""
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / 2.0**53


def _bin(surety: np.ndarray) -> np.ndarray:
    """The bin of each log-odds; -1 is not sure."""
    low = math.log(SURE / (1 - SURE))
    return np.where(surety > low, np.minimum((surety - low) / (MOST - low) * BINS, BINS - 1).astype(np.int64), -1)


def handed(views: tuple, numbers: np.ndarray, steps: list) -> list[np.ndarray]:
    """The label that each document was handed with to each view in these rounds; nan where it was not."""
    got = [np.full(len(numbers), np.nan) for _ in views]
    for models, cuts in steps:
        for me, other in ((0, 1), (1, 0)):
            odds, free = models[me].log_odds(views[me]), np.isnan(got[other])
            for label in (1, 0):
                at, (cut, share) = _bin(odds if label else -odds), cuts[me, label]
                got[other][free & (at >= 0) & ((at > cut) | ((at == cut) & (numbers < share)))] = label
    return got


def _cut(counts: np.ndarray, most: float) -> tuple[int, float]:
    """The bin down to which documents are handed over, and the share of it, so that they are `most`."""
    for at in range(BINS - 1, -1, -1):
        if counts[at] >= most:
            return at, most / counts[at] if counts[at] else 0.0
        most -= counts[at]
    return -1, 0.0


def _refit(models: list[Logistic], xs: list[np.ndarray], ys: list[np.ndarray], pool: Pool) -> list[Logistic]:
    """Models of both views fitted to the labelled rows and all that were handed over, starting from the given ones."""
    models = [m.copy() for m in models]
    for _ in range(STEPS):
        sums = pool.total(lambda views, got: {k: models[k].parts(views[k][~np.isnan(got[k])], got[k][~np.isnan(got[k])]) for k in (0, 1)})
        for k, model in enumerate(models):
            own = model.parts(xs[k], ys[k])
            if k in sums:
                own[: len(sums[k])] += sums[k]
            model.w = model.w - model.step(own)
    return models


class Trained:
    """The views' calibrated models, and what combines them."""

    def __init__(self, models: list[Calibrated], views: list[np.ndarray], y: np.ndarray):
        self.models = models
        self.joint = Logistic(self._odds(views), y)

    def _odds(self, views) -> np.ndarray:
        return np.column_stack([m.log_odds(v) for m, v in zip(self.models, views, strict=True)])

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """content_score, metadata_score and score."""
        odds = self._odds(views)
        return [_sigmoid(odds[:, 0]), _sigmoid(odds[:, 1]), _sigmoid(self.joint.log_odds(odds))]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Trained:
    """Both views trained over the rounds. A third of the labelled rows is held out to calibrate and combine them."""
    held = np.arange(len(y)) % 3 == 0
    taught = ~held
    if len(set(y[held])) < 2 or len(set(y[taught])) < 2:
        held = taught = np.ones(len(y), bool)
    xs, ys = [v[taught] for v in views], [y[taught].astype(float) for _ in views]
    models = [Logistic(x, t, *m) for x, t, m in zip(xs, ys, moments(pool.blocks), strict=True)]

    def calibrated(models: list[Logistic]) -> list[Calibrated]:
        return [Calibrated(m, v[held], y[held].astype(float)) for m, v in zip(models, views, strict=True)]

    rate = float(np.clip(y.mean(), 0.02, 0.98))
    for _ in range(rounds):
        now = calibrated(models)

        def counted(some: tuple, got: list[np.ndarray]) -> dict[int, np.ndarray]:
            out = {4: np.array([len(got[0])], float)}
            for me in (0, 1):
                odds, free = now[me].log_odds(some[me]), np.isnan(got[1 - me])
                for label in (1, 0):
                    at = _bin(odds if label else -odds)
                    out[2 * me + label] = np.bincount(at[free & (at >= 0)], minlength=BINS).astype(float)
            return out

        sums = pool.total(counted)
        quota = HANDED * float(sums.get(4, np.zeros(1))[0])
        if not quota:
            break
        cuts = {(me, label): _cut(sums[2 * me + label], quota * (rate if label else 1 - rate)) for me in (0, 1) for label in (1, 0)}
        pool.steps.append((now, cuts))
        models = _refit(models, xs, ys, pool)
    return Trained(calibrated(models), [v[held] for v in views], y[held].astype(float))


def _rows_of(blocks: DataFrame, quality: dict[int, int]) -> list[dict]:
    """doc_id, quality and views of the documents with these ids, of which there are at most LABELLED."""
    wanted = np.array(sorted(quality), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, views in _blocks(batches):
            at = [k for k, i in enumerate(ids) if i is not None and wanted[min(len(wanted) - 1, np.searchsorted(wanted, i))] == i]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()), *(pa.array(list(v[at]), pa.list_(pa.float64())) for v in views)], ["doc_id", "content", "metadata"])

    found = blocks.mapInArrow(run, "doc_id long, content array<double>, metadata array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("content", "metadata")).alias("v")).select("doc_id", "v.*").collect() if quality else []
    return sorted(({**r.asDict(), "quality": quality[r["doc_id"]]} for r in rows), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, blocks: DataFrame | None = None) -> Trained | None:
    """Models for documents, or None if the labels are not of both kinds. blocks are the features of docs, if there."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = {r["doc_id"]: r["quality"] for r in sample.collect()}
    kinds = np.array(list(chosen.values())) > 0
    if not len(kinds) or kinds.all() or not kinds.any():
        return None
    blocks = features(docs) if blocks is None else blocks
    rows = _rows_of(blocks, chosen)
    y = np.array([r["quality"] for r in rows]) > 0
    return co_train(tuple(np.array([r[c] for r in rows]) for c in ("content", "metadata")), y, Pool(blocks, np.array(list(chosen), np.int64)))


def score_blocks(blocks: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, body and the scores of every document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies, views in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.int64()), *map(pa.array, trained.scores(views))], ["doc_id", "body", *ADDED])

    return blocks.mapInArrow(run, ", ".join(["doc_id long, body long", *(f"{c} double" for c in ADDED)]))


def score(docs: DataFrame, trained: Trained | None) -> DataFrame:
    """docs with content_score, metadata_score (each view's calibrated by itself) and score (both) from 0 to 1."""
    if trained is None:
        return docs.withColumns({c: F.lit(1.0) for c in ADDED})
    kept = [f for f in docs.schema.fields if f.name not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 500):
            scores = trained.scores(_views(batch)) if batch.num_rows else [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *map(pa.array, scores)], [*(f.name for f in kept), *ADDED])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} double" for c in ADDED)])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs that score `keep` or more. Texts are read for their features once, and joined with the scores."""
    blocks = features(docs)
    trained = train(docs, labels, blocks=blocks)
    if trained is None:
        return docs
    kept = score_blocks(blocks, trained).where(F.col("score") >= keep).select(F.col("doc_id").alias("_good_id"), F.col("body").alias("_good_body")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_good_id")) & (body_of() == F.col("_good_body")), "left_semi")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the scores, and keep, of every document."""
    docs = table(spark, sf_dir, "documents")
    blocks = features(docs)
    trained = train(docs, table(spark, sf_dir, "labels"), blocks=blocks)
    scored = score(docs.select("doc_id"), None) if trained is None else score_blocks(blocks, trained)
    return scored.select("doc_id", "content_score", "metadata_score", "score", (F.col("score") >= KEEP).alias("keep"))
