import hashlib
import random

import pytest

import corpus_pipeline
from pagewright.llm import line_dedup, mixing, quality
from tests.llm import brute, test_line_dedup, test_packing, test_similar
from tests.llm.conftest import SCHEMA, odd_rows, prose
from tests.llm.test_mixing import plain_targets

KEEP, CUT, DEDUP, MIX, PACK = (stage for _, stage in corpus_pipeline.STAGES)


FOOTER = "All rights reserved to the owners of this site"


def small_corpus():
    """Documents of 14 sites with a shared footer, junk, copies and near copies; and labels."""
    rng, rows, labels = random.Random(12), [], []
    for i in range(140):
        text = prose(1000 + i, rng.randint(30, 160)) + "\n" + FOOTER
        if i % 7 == 3:
            text = " ".join(f"{w}$$$ |" for w in prose(2000 + i, 60).split())
        if i % 10 == 9:
            text = test_similar.edited(rows[-4][1], rng, 1) if i % 20 == 9 else rows[-2][1]
        rows.append((i * 3, text, rng.choice(["en", "de", None]), f"site{i % 14}", len(text)))
        labels.append((i * 3, int("$$$" not in text), 0))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = small_corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def as_rows(df):
    return brute.counted(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect())


def test_every_stage_does_what_a_plain_version_does(spark, folder):
    """Each stage on what the one before it left, and run() against the chain of them."""
    docs = corpus_pipeline.table(spark, folder, "documents")
    labels = corpus_pipeline.table(spark, folder, "labels")
    every = docs.collect()

    good = KEEP(spark, docs, folder)
    scored = quality.score(docs, quality.train(docs, labels)).collect()  # one pass over the texts, no join
    assert as_rows(good) == brute.counted(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in scored if r.score >= quality.KEEP)
    left = {r.doc_id for r in good.collect()}
    junk = {r.doc_id for r in every if "$$$" in r.text}
    assert not left & junk and len(left) == len(every) - len(junk)

    lines = CUT(spark, good, folder)
    known = [(r.doc_id, r.text, r.source) for r in good.collect()]
    want = test_line_dedup.plain(known, line_dedup.enough_sites(good))
    kept = {r.doc_id: r for r in lines.collect()}
    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in kept.items()} == {d: h for d, _, _, h in want}
    assert sum(FOOTER in r.text.split("\n") for r in kept.values()) == 1 and all(r.n_chars == len(r.text) for r in kept.values())

    firsts = DEDUP(spark, lines, folder)
    classes = test_similar.plain([(d, r.text) for d, r in kept.items()])
    assert sorted(r.doc_id for r in firsts.collect()) == sorted(d for d, c in classes.items() if d == c) and len(set(classes.values())) < len(classes)

    mixed = MIX(spark, firsts, folder).collect()
    unique = {r.doc_id: r for r in firsts.collect()}
    taken = {d: 0 for d in unique}
    for r in mixed:
        assert r == unique[r.doc_id]
        taken[r.doc_id] += 1
    size = {d: len(brute.words(r.text)) for d, r in unique.items()}
    own = {}
    for d, r in unique.items():
        own.setdefault(r.source, []).append(d)
    targets = plain_targets({s: sum(size[d] for d in some) for s, some in own.items()})
    for s, some in own.items():
        assert abs(sum(size[d] * taken[d] for d in some) - targets[s]) <= max(size[d] for d in some) / 2 + 1e-6
    assert max(taken.values()) <= mixing.MOST

    packed = PACK(spark, spark.createDataFrame(mixed, SCHEMA), folder).select(*test_packing.COLUMNS).collect()
    test_packing.check(packed, [(r.doc_id, r.text) for r in mixed])

    whole = corpus_pipeline.run(spark, folder).select(*test_packing.COLUMNS).collect()
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert brute.counted(map(piece, whole)) == brute.counted(map(piece, packed))
    test_packing.check(whole, [(r.doc_id, r.text) for r in mixed])


def test_stages_keep_the_columns_and_odd_rows(spark, odd, clashing, nothing, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, folder).columns == corpus_pipeline.COLUMNS, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == corpus_pipeline.COLUMNS and set(as_rows(out)) <= set(as_rows(odd)) or name == "line dedup", name
    classes = test_similar.plain([(r[0], r[1]) for r in odd_rows()[:16]])
    left = {r.doc_id for r in DEDUP(spark, odd, "").collect()}
    assert left == {d for d, c in classes.items() if d == c}
    assert PACK(spark, nothing, "").count() == 0


def test_runs_on_the_smallest_tables_and_leaves_one_folder(spark, sf):
    import os

    from pagewright.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(root) if "-" in x}
    rows = corpus_pipeline.run(spark, sf).collect()
    total = {}
    for r in rows:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert rows and all(sum(n for _, n in places) <= 1024 for places in total.values())
    new = {x for x in os.listdir(root) if x.startswith(tuple(n.replace(" ", "-").lower() for n, _ in corpus_pipeline.STAGES))} - before
    assert len(new) == 1
