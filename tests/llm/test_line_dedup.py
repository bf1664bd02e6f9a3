import hashlib

from pagewright.llm import line_dedup as L
from tests.llm import brute
from tests.llm.conftest import odd_rows


def plain(docs, sites):
    where, texts, first = {}, {}, {}
    for doc, text, source in docs:
        for line in (text or "").split("\n"):
            if key := line.strip(" \t\n\x0b\x0c\r"):
                where.setdefault(key, set()).add(source)
                texts.setdefault(key, set()).add(text)
                first[key] = doc if first.get(key) is None else first[key] if doc is None else min(first[key], doc)
    common = {k for k, s in where.items() if len(s - {None}) >= sites and len(texts[k]) >= sites}
    out = []
    for doc, text, _ in docs:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in common or (doc is not None and doc <= first[x.strip(" \t\n\x0b\x0c\r")])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_spread_lines_go(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"own line {i}\nshared by many\n  near {i % 7} \n\nshared by many", f"site{i % 13}"))
        rows.append((1000 + i, "copied text\nof one kind", f"site{i % 13}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (4, 8, 13):
        got = L.dedup_lines(docs, sites).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert brute.counted(got) == brute.counted(plain(rows, sites))


def test_odd_documents(odd, clashing, nothing):
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    got = L.dedup_lines(odd, 2).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert brute.counted(got) == brute.counted(plain(rows, 2))
    kept = L.dedup_lines(clashing, 2)
    assert kept.count() == len(rows) and {"body", "found", "text"} <= set(kept.columns)
    assert L.dedup_lines(nothing).count() == 0


def test_few_sites_need_half_of_them(spark):
    rows = [(i, f"own line {i}\nfooter", f"site{i % 3}") for i in range(9)] + [(20, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert L.enough_sites(docs) == 2
    got = L.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert brute.counted(got) == brute.counted(plain(rows, 2)) and sum(r.n_removed for r in got) == 8
    many = docs.unionByName(spark.range(40).selectExpr("100 + id as doc_id", "'x' as text", "concat('s', id) as source"))
    assert L.enough_sites(many) == L.SITES and L.enough_sites(docs.limit(0)) == 2


def test_lines_are_one_with_either_line_end(spark):
    rows = [(i, f"own line {i}{end}\nshared footer{end}\n\t \nlast", f"site{i}") for i, end in enumerate(["\r", "", "\t", " \r", "\x0b"] * 4)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert brute.counted(got) == brute.counted(plain(rows, 10)) and sum(r.n_removed for r in got) == 2 * 19
