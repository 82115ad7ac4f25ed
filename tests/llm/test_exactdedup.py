import hashlib

from prismrank.llm import exactdedup

ROWS = [(1, "Abc"), (2, "abc"), (3, "ABC"), (3, "aBC"), (4, None), (5, ""), (None, "abc"), (None, "solo"), (None, "solo"), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "y")]
SCHEMA = "doc_id long, text string, address string, kept int"


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(exactdedup.fold(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            mine = i == keep and not done
            done = done or mine
            out.append((i, keep, len(ids), mine, hashlib.sha256(t).hexdigest()))
    return sorted(out, key=str)


def test_all_cases_even_with_a_table_that_must_spill(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], SCHEMA).repartition(3)
    assert sorted(map(tuple, exactdedup.documents_digest(docs).collect()), key=str) == expected(ROWS)
    tiny = exactdedup.exact_dedup(docs, memory_bytes=1)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.address).hex()) for r in tiny.collect()), key=str) == expected(ROWS)


def test_grace_spills_recursively_and_loses_nothing(tmp_path):
    records = [(hashlib.sha256(b"%d" % (i % 3000)).digest(), b"%d" % (i % 3000), i, 1) for i in range(9000)]
    tables = list(exactdedup.grace(iter(records), 2000, str(tmp_path)))
    assert len(tables) > 20
    got = {t: (i, n) for x in tables for t, i, n in zip(x.texts, x.ids, x.counts)}
    assert got == {b"%d" % i: (i + 6000, 3) for i in range(3000)}
    assert sum(len(x.texts) for x in tables) == 3000 and not list(tmp_path.iterdir())


def test_kept_rows_have_all_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], SCHEMA)
    kept = exactdedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in expected(ROWS) if x[3]), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exactdedup.documents_digest(docs).count() == 0 and exactdedup.keep_unique(docs).count() == 0


def test_columns_with_the_names_that_operators_use(spark):
    rows = [(1, "A", "x", 7, "p", "q"), (2, "a", "y", 8, "r", "s"), (3, "d", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __mark int, __own string, own_0 string")
    got = exactdedup.keep_unique(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows[1:]
