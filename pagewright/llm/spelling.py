"""Spelling variants by a relational trie frontier.

The words of the corpus (counted in the tasks first, then summed up) form two tries, one of the words and one of the
words reversed, kept as a distributed table of edges (node, letter, child), where a node is the hash of what leads to it.
Every word walks both as states (word, position, node, edits): the positions without an edit are known at once, as a word
is its own path; one join with the edges makes all states with one edit (a letter inserted, deleted or replaced); and
level by level the frontier of those is joined with the edges by node and next letter, until the word ends. An edit in
the second half of a word is looked for in the first trie, one in the first half in the second: so no state begins near
a root, where every letter branches. Edges also know which letters may follow, as a bit mask, so a state without a way
on is dropped within the join that would make it. States whose word has ended are candidates, and so are the few that
are left after the last level; all of them are decided by a join with the words themselves, so a hash that two nodes
share can't make a neighbour.

Words of 64 letters and more would have too many states: they meet by the hashes of all they become by one deletion, and
are decided by the edit distance itself.

Every word with one far more frequent near word takes that as its form; forms are followed by pointer doubling.

Defined results: null texts have no words; a null id counts as an empty string where ids are hashed; repeated rows count
as often as they occur; no words gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ASCII_LOWER, durable, each_batch, raw_texts, table

#: Letters in UTF-8, once A-Z are lowered: a-z and U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SHORTEST, OFTEN, RATIO, DROPPED = 6, 5, 5, 199
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Levels after which the states that are left are looked up whole.
LEVELS = 6
#: Letters from which on words are not walked through the tries.
DEEP = 64
#: The bit of a mask that says that a word ends.
END = -(1 << 63)


def words(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, dropped: int = DROPPED) -> DataFrame:
    """word and n: lower-cased runs of letters of whole texts, one in `dropped` of them (by the hash of document and run)
    without one letter; those of at least so many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in each_batch(batches, 500):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                seed = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for found, n in Counter(LETTERS.findall((raw or b"").translate(ASCII_LOWER))).items():
                    h = zlib.crc32(found, seed)
                    if h % dropped == 0:
                        letters = found.decode()
                        at = h % len(letters)
                        found = (letters[:at] + letters[at + 1 :]).encode()
                    if len(found) - found.count(b"\xc3") >= shortest:
                        total[found] += n
                if len(total) > COUNTED:
                    yield handed()
        yield handed()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _bit(letter: Column) -> Column:
    """The bit of a letter in a mask of those that may follow; letters that share one only cost a look."""
    return F.when(letter == "", F.lit(END)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % 63))


def _part(text: str, start: Column, length: Column | None = None) -> Column:
    """Letters of a column from a place (from 0) on."""
    return F.substring(F.col(text), start + 1, F.lit(1 << 20) if length is None else length)


def _both_ways(vocabulary: DataFrame) -> DataFrame:
    """Each word as it is and reversed (side, s), with its number of letters."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))
    return vocabulary.select("word", F.length("word").alias("size"), F.inline(sides))


def trie_edges(vocabulary: DataFrame) -> DataFrame:
    """node, letter, child and ahead (a mask of the letters that follow) of both tries, from the depth on at which a
    state may begin."""
    size, at = F.col("size"), F.col("at")
    rows = _both_ways(vocabulary).withColumn("at", F.explode(F.sequence(F.floor((size - 1) / 2).cast("int"), size - 1)))
    node = lambda n: F.xxhash64("side", _part("s", F.lit(0), n))
    rows = rows.select(node(at).alias("node"), _part("s", at, F.lit(1)).alias("letter"), node(at + 1).alias("child"), _bit(_part("s", at + 1, F.lit(1))).alias("bit"))
    return rows.groupBy("node", "letter", "child").agg(F.bit_or("bit").alias("ahead"))


def one_edit(vocabulary: DataFrame, edges: DataFrame) -> DataFrame:
    """word, cand (what the edit makes of it), rest (the letters still to be matched) and node of every state with one
    edit that has a way on."""
    size, at = F.col("size"), F.col("at")
    # an edit in the second half belongs to the words as they are, one in the first half to the reversed
    first = F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(size - F.floor(size / 2)).cast("int")
    rows = _both_ways(vocabulary).withColumn("at", F.explode(F.sequence(first, size)))
    rows = rows.select("word", "side", "s", "at", F.xxhash64("side", _part("s", F.lit(0), at)).alias("node"))
    here, then = _part("s", at, F.lit(1)), _part("s", at + 1, F.lit(1))
    whole = lambda s: F.when(F.col("side") == 0, s).otherwise(F.reverse(s))
    head, letter = _part("s", F.lit(0), at), F.col("letter")

    def state(when: Column, made: Column, rest: Column) -> Column:
        way_on = F.col("ahead").bitwiseAND(_bit(F.substring(rest, 1, 1))) != 0
        return F.when(when & way_on, F.struct(whole(made).alias("cand"), rest.alias("rest"), F.col("child").alias("node")))

    replaced = state((here != "") & (letter != here), F.concat(head, letter, _part("s", at + 1)), _part("s", at + 1))
    inserted = state(letter != here, F.concat(head, letter, _part("s", at)), _part("s", at))
    deleted = state((here != "") & (letter == then) & (here != then), F.concat(head, _part("s", at + 1)), _part("s", at + 2))
    made = rows.join(edges, "node").select("word", F.array_compact(F.array(replaced, inserted, deleted)).alias("states")).where(F.size("states") > 0)
    states = made.select("word", F.inline("states"))
    ends = rows.where(at == F.length("s") - 1).select("word", whole(head).alias("cand"), F.lit("").alias("rest"), "node")  # the last letter deleted
    return states.unionByName(ends)


def _shortened(vocabulary: DataFrame) -> DataFrame:
    """word and other: long words whose hashes after one deletion, or before it, meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        modulus, base = (1 << 61) - 1, 1_000_003
        for batch in batches:
            for word in batch.column("word").to_pylist():
                head, powers = [0], [1]
                for letter in word:
                    head.append((head[-1] * base + ord(letter)) % modulus)
                    powers.append(powers[-1] * base % modulus)
                n, whole = len(word), head[-1]
                # head * base^(rest) + the hash of the rest
                keys = {whole} | {(head[k] * powers[n - k - 1] + whole - head[k + 1] * powers[n - k - 1]) % modulus for k in range(n)}
                yield pa.RecordBatch.from_arrays([pa.array([word] * len(keys), pa.string()), pa.array(list(keys), pa.int64())], ["word", "key"])

    keyed = vocabulary.select("word").mapInArrow(run, "word string, key long")
    return keyed.join(keyed.withColumnRenamed("word", "other"), "key").where("word <> other").select("word", "other").distinct()


def near_words(vocabulary: DataFrame, levels: int = LEVELS) -> DataFrame:
    """word, other and other_n of every two words that differ by one letter inserted, deleted or replaced, either way."""
    short = vocabulary.where(F.length("word") <= DEEP).select("word")
    edges = durable(trie_edges(short))
    frontier = durable(one_edit(short, edges))
    ended = [frontier.where("rest = ''").select("word", "cand")]
    frontier = frontier.where("rest <> ''")
    for _ in range(levels):
        letter, following = F.substring("rest", 1, 1), F.substring("rest", 2, 1)
        step = frontier.withColumn("letter", letter).join(edges, ["node", "letter"])
        step = step.where(F.col("ahead").bitwiseAND(_bit(following)) != 0)
        frontier = durable(step.select("word", "cand", F.expr("substring(rest, 2)").alias("rest"), F.col("child").alias("node")))
        ended.append(frontier.where("rest = ''").select("word", "cand"))
        frontier = frontier.where("rest <> ''")
        if frontier.isEmpty():
            break
    else:
        ended.append(frontier.select("word", "cand"))
    found = ended[0]
    for more in ended[1:]:
        found = found.union(more)
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = found.withColumnRenamed("cand", "other").distinct().join(known, "other").select("word", "other", "other_n")
    long = vocabulary.where(F.length("word") >= DEEP)
    apart = _shortened(long).where(F.levenshtein("word", "other", 1) == 1).join(known, "other").select("word", "other", "other_n")
    return near.where("word <> other").union(apart).distinct()


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n)."""
    vocabulary = durable(vocabulary.select("word", "n"))
    near = near_words(vocabulary, levels).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    takes = -F.col("best.minus") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("best.other")).alias("form"),
        F.when(takes, -F.col("best.minus")).alias("form_n"),
    )
    rows = durable(rows)
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # counts grow by the ratio with every form, so a chain is short, and each round doubles what it covers
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = durable(roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent near form and the root that forms lead to."""
    return group_variants(words(table(spark, sf_dir, "documents")))
