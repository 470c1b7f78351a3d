"""Quality rules, line deduplication and mixing; the pipeline's stages against brute force."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from datadict.llm import line_dedup, mixing, ngram_join, packing, quality
from datadict.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
EXTRA = DOCS + ", copy string, `drop` string, kept string, measures string, text_key string, steps string, lines string"


def documents(spark, rows, schema=EXTRA):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], schema)


PLAIN = "one two three four five six seven eight nine ten eleven twelve"
EDGES = [
    (1, PLAIN, "en", "a", 1), (1, PLAIN, "en", "a", 1), (2, None, None, "a", None), (3, "", "en", None, 0),
    (None, PLAIN + " x", "en", None, 2), (4, "w " * 40, "en", "a", 3), (5, "#$% " * 12, "en", "a", 4), (6, "word " * 20000, "en", "b", 5)]


def words_of(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def repeated(words):
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)})


def test_measures(spark):
    got = quality.verdict_rows(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    want = Counter((i, len(words_of(t)), sum(map(len, words_of(t))), sum(c in quality.SYMBOLS for c in t or ""),
                    repeated(words_of(t))) for i, t, *_ in EDGES)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) for r in got) == want
    verdicts = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got}
    assert verdicts[1] == (False, True) and verdicts[2] == (True, False) and verdicts[5][1] is False


def test_quality_stage_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, EDGES)
    kept = quality.quality_rules(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_bad_host_confirms_failures(spark):
    odd = PLAIN + " # $ % &"
    rows = [(i, PLAIN if i % 2 else odd, "en", "bad", 1) for i in range(40)]
    rows += [(100 + i, PLAIN if i else odd, "en", "good", 1) for i in range(400)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdict_rows(documents(spark, rows), quality.Limits(confirm=0.1)).collect()}
    assert [got[i] for i in range(4)] == [False, True, False, True]
    assert all(got[100 + i] for i in range(400))  # one oddity of a sound host is no failure


def test_line_dedup(spark):
    rows = [(i, f"Site menu\nbody {i}\n\n Site menu \t", "en", "a", 9) for i in range(6)]
    rows += [(10, "Site menu\nother host", "en", "b", 9), (11, None, "en", "a", None), (12, "", "en", "a", 0),
             (13, "Site menu", "en", None, 9)]
    rows += [(20 + i, "copied line\nall the same", "en", "c", 9) for i in range(5)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, counts=("before", "gone")).collect()}
    assert all(got[i]["text"] == f"body {i}\n" and got[i]["n_chars"] == len(f"body {i}\n") and got[i]["gone"] == 2 for i in range(6))
    assert got[10]["text"] == "Site menu\nother host" and got[11]["text"] is None and got[12]["text"] == ""
    assert got[13]["text"] == "Site menu"
    assert got[20]["text"] == "copied line\nall the same"  # copies of one page are one page
    assert line_dedup.line_dedup(docs.limit(0)).columns == docs.columns


def test_mixing_draws_poisson(spark):
    rows = [(i, "t", "en", "big" if i % 4 else "small", 1) for i in range(8000)] + [(None, None, None, None, None)] * 2
    out = mixing.mix(documents(spark, rows, DOCS), {"big": 1, "small": 3, None: 0.0}).collect()
    per = Counter(r["source"] for r in out)
    assert abs(per["small"] / len(out) - 0.75) < 0.03 and abs(len(out) - 8002) < 300 and None not in per
    counts = Counter(Counter(r["doc_id"] for r in out if r["source"] == "small").values())
    rate = 8002 * 0.75 / 2000
    for k in range(1, 6):
        assert abs(counts[k] / 2000 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.04
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values())


def test_mixing_edges(spark):
    docs = documents(spark, EDGES)
    out = mixing.mix(docs, size=4.0, copy="c_no", key="c_key")
    assert out.columns == [*docs.columns, "c_no", "c_key"]
    assert mixing.mix(docs.limit(0), copy="c_no", key="c_key").count() == 0
    ones = Counter(r["c_no"] for r in out.where("doc_id = 1").collect())
    assert all(v == 2 for v in ones.values())  # equal ids draw alike
    many = mixing.mix(documents(spark, [(1, "t", "en", "a", 1)], DOCS), size=3000.0)
    assert abs(many.count() - 3000) < 400


def test_mixing_keeps_columns_of_its_own_names(spark):
    rows = [(i, "t", "en", "a", 1, f"c{i}", -i, "m") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long,"
                                       " copy string, mix_key long, mix_source string").repartition(3)
    out = mixing.mix(docs, size=2.0)
    assert out.columns == [*docs.columns, "_copy", "_mix_key"]
    assert {(r["doc_id"], r["copy"], r["mix_key"], r["mix_source"]) for r in out.collect()} <= {(r[0], *r[5:]) for r in rows}


def test_mixing_of_large_means(spark):
    """The steps span the mean's deviations only, and give the distribution of the exact sums."""
    import math as m

    table = spark.createDataFrame([("x", 900.0), ("y", 1e8), ("z", 3.5), ("w", 250.0)], "mix_source string, rate double")
    for r in mixing.cumulative(table).collect():
        rate = {"x": 900.0, "y": 1e8, "z": 3.5, "w": 250.0}[r["mix_source"]]
        assert len(r["steps"]) <= 25 * m.sqrt(rate) + 45 and abs(r["steps"][-1] - 1) < 1e-6
        if rate < 1e6:
            total, want = 0.0, []
            for k in range(r["first"] + len(r["steps"])):
                total += m.exp(-rate + k * m.log(rate) - m.lgamma(k + 1))
                want.append(total)
            assert max(abs(a - b) for a, b in zip(r["steps"], want[r["first"]:])) < 1e-9


def test_null_ids_draw_by_their_texts(spark):
    rows = [(None, f"text {i}", "en", "a", 1) for i in range(400)]
    out = mixing.mix(documents(spark, rows, DOCS), size=2.0).collect()
    assert len({r["mix_key"] for r in out}) == len(out) and len(Counter(Counter(r["text"] for r in out).values())) > 3


# --- the whole pipeline on a small table --------------------------------------------------------

def sql_of(con, text, rows):
    con.execute("drop table if exists documents")
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    result = con.execute(text)
    names = [d[0] for d in result.description]
    return [dict(zip(names, r)) for r in result.fetchall()]


def groups(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))], sets


def test_pipeline_against_brute_force(spark, sf_dir):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mixing", "best_fit_packing"]

    kept = {r["doc_id"] for r in sql_of(con, quality.sql(), rows) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    cleaned = {r["doc_id"]: r["text"] for r in sql_of(con, line_dedup.sql(), rows)}
    rows = sorted((i, cleaned[i], lang, source, len(cleaned[i])) for i, _, lang, source, _ in rows)
    root, sets = groups([r[1] for r in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if root[i] == i or not sets[i]]
    mixed = [tuple(r[c] for c in docs.columns) for r in sql_of(con, mixing.sql(), rows)]

    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == docs.columns, name
    assert Counter(tuple(r) for r in frame.collect()) == Counter(mixed)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in mixed)
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    total = sum(filled.values())
    assert max(filled.values()) <= packing.CAPACITY and len(filled) <= total // packing.CAPACITY + 2


@pytest.mark.parametrize("name", ["op3_line_dedup", "op8_quality_rules", "op9_mixing"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    result = con.execute(q.ORACLES[name])
    names = [d[0] for d in result.description]
    df = q.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_stages_take_edge_rows(spark, sf_dir):
    docs = documents(spark, EDGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() >= 0 and stage(spark, docs.limit(0), sf_dir).count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns


def test_one_of_each_keeps_one_of_equal_rows(spark):
    rows = [(1, PLAIN, "en", "a", 1)] * 3 + [(7, PLAIN, "en", "a", 1), (None, PLAIN, "en", "a", 1), (9, None, "en", "a", 1), (9, None, "en", "a", 1),
                                             (8, "", "en", "a", 1), (3, "quite another text of words", "en", "a", 1)]
    got = ngram_join.one_of_each(documents(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 8, 9, 9] or sorted(r["doc_id"] for r in got.collect()) == [1, 3, 8, 9]
