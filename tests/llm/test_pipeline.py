"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as P
from test_queries_llm import SMALL, brute_lines, brute_near

from stratoplane.llm import language
from stratoplane.shared_store import written
from stratoplane.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark):
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_copies", "mixture", "packing"]
    docs = table(spark, SMALL, "documents")
    out = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        out.append(docs)
        if name != "packing":
            assert docs.columns == COLUMNS
    texts = [sorted((r["doc_id"], r["text"]) for r in df.collect()) for df in out[:4]]
    start = sorted((r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect())
    assert texts[0] == [r for r in start if r[1] is not None and any(c.isalpha() for c in r[1])]
    lines = {i: h for i, _, gone, h in brute_lines(texts[0])}
    emptied = {i for i, h in lines.items() if h == hashlib.sha256(b"").hexdigest()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts[1]} == {i: h for i, h in lines.items() if i not in emptied}
    assert texts[2] == [r for r in texts[1] if r[0] in {c for _, _, c in brute_near(texts[1])}]
    copies = Counter(i for i, _ in texts[3])
    assert set(copies) <= {i for i, _ in texts[2]} and max(copies.values()) <= 2
    words = lambda rows: sum(len(t.split(" ")) for _, t in rows)
    assert 1.3 * words(texts[2]) < words(texts[3]) < 1.7 * words(texts[2])
    pieces = out[4].collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == copies
    fill = defaultdict(int)
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_run_gives_the_stages_result(spark):
    found = P.run(spark, SMALL)
    again = P.run(spark, SMALL)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(found) == key(again)


def test_stages_on_odd_and_empty_tables(spark, folder):
    for where in ("odd", "empty"):
        docs = spark.read.parquet(f"{folder}/{where}/documents.parquet")
        for name, stage in P.STAGES:
            columns = docs.columns
            docs = written(stage(spark, docs, f"{folder}/{where}"), name)
            if name != "packing":
                assert docs.columns == columns
        assert (docs.count() == 0) == (where == "empty")


def test_columns_with_names_of_results_keep_their_values(spark, edge_docs):
    docs = edge_docs
    for _, stage in P.STAGES[:4]:
        docs = written(stage(spark, docs, ""), "odd")
        assert docs.columns == edge_docs.columns
        assert docs.count() and docs.where("size = -1 AND kept = 'x' AND score = 0.5D AND held_out AND n_lines = 7 AND component = 'y'").count() == docs.count()


def test_rows_of_one_id_or_none(spark):
    rows = [(4, "some words here that nobody else has", "en", "a", 3), (4, "quite another text under this id", "en", "a", 3), (None, "rows without an id stay", "en", "b", 1), (None, "rows without an id stay", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [tuple(r) for r in P.one_of_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=repr) in (sorted([rows[0], *rows[2:]], key=repr), sorted([rows[1], *rows[2:]], key=repr))
    mixed = P.mixed_sources(spark, docs, "").collect()
    assert all(tuple(r) in rows for r in mixed)


def test_near_copies_of_a_large_bucket_go(spark, monkeypatch):
    """All documents share one bucket; two are similar, and neither is the bucket's smallest."""
    from stratoplane.llm import near_copies

    monkeypatch.setattr(near_copies, "band_hashes", lambda sig: sig[:1] * 0)
    texts = [" ".join(f"d{i}_{k}" for k in range(40)) for i in range(300)]
    docs = [(i, t, "en", "a", len(t)) for i, t in enumerate([*texts, texts[207] + " more"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.one_of_near_copies(spark, frame, "").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == list(range(300))


def test_only_texts_without_language_are_rejected(spark, edge_docs):
    kept = P.known_language(spark, edge_docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r["doc_id"]) for r in edge_docs.collect() if r["text"] and language.has_letter(r["text"].encode()))
