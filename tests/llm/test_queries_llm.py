"""Each query against brute force or SQL, and on odd and empty tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from stratoplane.llm import bytetext, line_dedup, media, mixture, near_copies, packing, registry, repeated_spans, topk, warc

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{folder}/documents.parquet"))]


def by_sql(name, folder):
    con = duckdb.connect()
    for t in TABLES:
        try:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SMALL else '/*.parquet'}')")
        except duckdb.IOException:
            pass
    return con.sql(registry.ORACLES[name]).df()


def same(spark_df, frame):
    mine = spark_df.toPandas()[sorted(frame.columns)]
    key = lambda f: sorted(map(tuple, f[sorted(frame.columns)].astype(object).where(f[sorted(frame.columns)].notna(), None).values.tolist()), key=repr)
    assert key(mine) == key(frame)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    same(registry.QUERIES[name](spark, SMALL), by_sql(name, SMALL))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, folder, name):
    assert registry.QUERIES[name](spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n not in ("op5_packing", "op6_warc", "op8_top_k")])
def test_one_row_for_each_odd_document(spark, folder, name):
    found = rows(registry.QUERIES[name](spark, f"{folder}/odd"))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in texts(spark, f"{folder}/odd"))


# --- helpers


def test_word_hashes_follow_the_words():
    text = ["a bb a\x0bccc", "", None, " ", "bb a", "é é", "z" * 600_000 + " z"]
    import pyarrow as pa

    data, offsets = bytetext.column_bytes(pa.array(text))
    starts, ends, first = bytetext.word_bounds(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [w.encode() for t in text for w in (t or "").split()]
    assert np.diff(first).tolist() == [len((t or "").split()) for t in text]
    seen = dict(zip(words, bytetext.word_hashes(data, starts, ends).tolist()))
    assert [seen[w] for w in words] == bytetext.word_hashes(data, starts, ends).tolist() and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10, 50])
def test_gram_hashes_depend_on_their_words_only(k):
    words = bytetext.mix(np.arange(90, dtype=np.uint64) % np.uint64(30))
    grams = bytetext.gram_hashes(words, k)
    assert len(grams) == 91 - k
    assert (grams[: 31 - k if k <= 30 else 1][:1] == grams[30:31]).all() if k <= 60 else True
    runs = {tuple(words[i : i + k].tolist()) for i in range(len(grams))}
    assert len(set(grams.tolist())) == len(runs)


# --- 1


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in rows(registry.QUERIES["op1_toxicity"](spark, folder))}
    labels = [(r["doc_id"], r["toxic"]) for r in rows(spark.read.parquet(f"{folder}/labels.parquet")) if found[r["doc_id"]]["held_out"]]
    hit = sum(found[i]["predicted"] for i, y in labels if y)
    wrong = sum(found[i]["predicted"] for i, y in labels if not y)
    assert hit / sum(y for _, y in labels) > 0.85 and wrong / sum(1 - y for _, y in labels) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())


def test_label_model_finds_good_and_doubled_voters():
    """Voters alone: the posterior beats every voter, a doubled voter has half a vote, an idle one counts for nothing."""
    from stratoplane.llm.toxicity import label_model

    draw = np.random.default_rng(1)
    truth = draw.random(3000) < 0.3
    voter = lambda right: np.where(np.where(draw.random(3000) < right, truth, ~truth), 1, -1)
    good, fair = voter(0.85), np.column_stack([voter(0.8) for _ in range(4)])
    votes = np.column_stack([good, good, fair, np.zeros(3000), voter(0.5)]).astype(np.int8)
    post, accuracy, share = label_model(votes)
    right = ((post > 0.5) == truth).mean()
    assert right > 0.88 and all(right > ((votes[:, k] == 1) == truth).mean() for k in (0, *range(2, 6)))
    assert share[0] < 0.75 * share[2:6].min() and np.abs(accuracy[:6] - [0.85, 0.85, 0.8, 0.8, 0.8, 0.8]).max() < 0.06 and accuracy[7] < 0.65


def test_posterior_beats_noisy_labels():
    """Labels with a tenth wrong choose the voters; the posterior of the votes is nearer to the truth than they are, and not equal to them."""
    from stratoplane.llm.toxicity import Model

    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    mean, plain = [word() for _ in range(12)], [word() for _ in range(400)]
    truth = draw.random(900) < 0.3
    texts = [" ".join([*draw.choice(plain, 40), *(draw.choice(mean, 5) if y else [])]).encode() for y in truth]
    gold = np.where(draw.random(900) < 0.1, ~truth, truth).astype(np.int64)
    model = Model(texts[:600], gold[:600], texts[600:], 0.3)
    found = model.posterior > 0.5
    assert (found == truth).mean() > 0.98 > (gold == truth).mean() and (found[:600] != gold[:600]).any()


# --- 2


def test_media_round_trip(spark, folder):
    found = defaultdict(list)
    for r in rows(registry.QUERIES["op2_media_columns"](spark, f"{folder}/odd")):
        found[r["doc_id"]].append(r)
    for i, text in texts(spark, f"{folder}/odd"):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        for r in found[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert (r["media_bytes"], r["media_sha256"]) == (len(media.wav_bytes(raw)), hashlib.sha256(media.wav_bytes(raw)).hexdigest())
    assert found[6][0]["feature"] == found[15][0]["feature"] and found[0][0]["feature"] == found[1][0]["feature"]
    assert len({found[i][0]["feature"] for i in (4, 8, 10, 11, 12, 13)}) == 6


def plain_fingerprint(payload):
    """The pairs by a direct transform, frame by frame, and plain loops."""
    import cmath
    import math

    n = media.FRAME
    frames = 1 + -(-len(payload) // media.HOP)
    x = [0.0] * (n // 2) + [b - 128.0 for b in payload]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    power = []
    for t in range(frames):
        part = x[t * media.HOP : t * media.HOP + n]
        part += [0.0] * (n - len(part))
        mean = sum(part) / n
        part = [(v - mean) * w for v, w in zip(part, window)]
        power.append([abs(sum(v * cmath.exp(-2j * math.pi * k * f / n) for k, v in enumerate(part))) ** 2 for f in range(1, n // 2)])
    found = []
    for t in range(frames):
        own = []
        for f, p in enumerate(power[t]):
            near = [power[a][b] for a in range(max(0, t - 1), min(frames, t + 2)) for b in range(max(0, f - 4), min(n // 2 - 1, f + 5))]
            if p > 0 and p >= max(near):
                own.append((-p, f + 1))
        found += sorted((t, f) for _, f in sorted(own)[:3])
    out = []
    for i, (t, f) in enumerate(found):
        out += [(t << 17) | (f << 10) | (g << 3) | (u - t) for u, g in found[i + 1 : i + 7] if u - t <= 7]
    return sorted(out)


def test_fingerprints_by_a_plain_transform(spark):
    texts = ["", "short", "Some more words than a frame holds. " * 20, "\u00e9t\u00e9 d\u00e9j\u00e0 vu " * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.fingerprints(media.store_wav(frame, "doc_id", "text"), "doc_id").collect():
        raw = texts[r["doc_id"]].encode()
        assert r["fingerprint"] == plain_fingerprint(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))


def test_peaks_find_a_tone_and_do_not_depend_on_blocks(monkeypatch):
    t = np.arange(64 * 200)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME) * (1 + 0.2 * np.sin(t / 900))).astype(np.uint8).tobytes()
    time, place = media.peaks(tone)
    power = media.spectrogram(np.frombuffer(tone, np.uint8), 2, 90)
    # The tone is the strongest frequency everywhere; where it is loudest it is a peak, and no peak is louder.
    assert (power.argmax(axis=1) + 1 == 20).all()
    loud = [power[t - 2, f - 1] for t, f in zip(time, place) if 2 <= t < 90]
    assert loud and max(loud) == power.max() and 20 in place[time == power.max(axis=1).argmax() + 2]
    noise = np.random.default_rng(1).integers(0, 256, 64 * 300).astype(np.uint8).tobytes()
    whole = media.peaks(noise)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(media.peaks(noise), whole))
    pairs = media.peak_pairs(*whole)
    assert (np.diff(pairs >> 17) >= 0).all() and ((pairs & 7) <= 7).all() and len(pairs) > len(whole[0])


# --- 3


def brute_lines(docs):
    keys, keeper = {}, {}
    for n, (i, text) in enumerate(docs):
        keys[n] = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]
        for k in keys[n] if i is not None else []:
            keeper.setdefault(k, set()).add(i)
    out = []
    for n, (i, text) in enumerate(docs):
        lines = (text or "").split("\n")
        gone = [i is not None and len(k) >= 10 and len(keeper[k]) > 1 and i > min(keeper[k]) for k in keys[n]]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_on_odd_rows(spark, folder):
    found = rows(registry.QUERIES["op3_line_dedup"](spark, f"{folder}/odd"))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found), key=repr) == brute_lines(texts(spark, f"{folder}/odd"))


def test_hot_line_and_bitmaps(spark):
    docs = [(i, f"a very common line\nown line number {i}\nA VERY common line ") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    maps = {r["doc"]: [tuple(x) for x in r["keep"]] for r in line_dedup.keep_bitmaps(frame, "doc_id", "text").collect()}
    assert maps == {i: [(1, 1)] for i in range(1, 400)}


# --- 4


def brute_spans(docs, window=50):
    first = {}
    for i, text in docs:
        w = SPLIT.findall(text or "")
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        w = SPLIT.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def spans_of(spark, docs, by_join=None):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = repeated_spans.without_spans(frame, repeated_spans.repeated_spans(frame, "doc_id", "text", by_join), "doc_id", "text")
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in kept.collect()), key=repr)


@pytest.mark.parametrize("by_join", [False, True])
def test_spans_on_odd_rows(spark, folder, by_join):
    docs = [d for d in texts(spark, f"{folder}/odd") if len(d[1] or "") < 100_000]
    docs += [(9, "another text of nine " + " ".join(f"w{i}" for i in range(70)))]
    assert spans_of(spark, docs, by_join) == brute_spans(docs)


@pytest.mark.parametrize(("hot", "by_join"), [(100, False), (2, False), (2, True)])
def test_spans_of_shared_passages(spark, monkeypatch, hot, by_join):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    draw = np.random.default_rng(5)
    passages = [" ".join(f"p{k}_{j}" for j in range(n)) for k, n in enumerate((49, 50, 51, 90, 200))]
    docs = []
    for i in range(150):
        parts = [" ".join(f"r{x}" for x in draw.integers(0, 10_000, 30)) for _ in range(3)]
        docs.append((int(i), " ".join([parts[0], passages[draw.integers(5)], parts[1], "same " * 70 if i % 9 == 0 else "", passages[draw.integers(5)], parts[2]])))
    assert spans_of(spark, docs, by_join) == brute_spans(docs)


def test_sketch_grows_with_the_texts(spark):
    """At every size the sketch lets few windows through that do not repeat, and all that do."""
    for n in (200, 4000):
        docs = [(i, " ".join(f"u{i}_{k}" for k in range(120))) for i in range(n)]
        docs += [(n + i, docs[i][1]) for i in range(20)]
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        pieces = repeated_spans.sketch_pieces(frame, "text")
        found = repeated_spans.estimated_repeats(frame, "text", pieces).count()
        real = len({int(a) for _, _, _, _, anchors, _, _ in repeated_spans.anchor_runs(repeated_spans.pa.array([t for _, t in docs[:20]])) for a in anchors})
        every = real * n / 20
        assert real <= found <= real + 0.05 * every


# --- 5


@pytest.mark.parametrize("where", ["small", "odd"])
def test_packing_is_whole_and_tight(spark, folder, where):
    from tokenizers import Tokenizer

    at = SMALL if where == "small" else f"{folder}/odd"
    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    want = []
    for i, text in texts(spark, at):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    found = rows(registry.QUERIES["op5_packing"](spark, at))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 2


def test_improve_empties_a_bin_that_best_fit_leaves():
    lengths = [6, 5, 5, 4, 4, 3, 3]
    bins = [[0, 5], [1, 3], [2, 4], [6]]
    assert sorted(map(len, packing.improve(bins, lengths, 10))) != [] and len(packing.improve(bins, lengths, 10)) == 3


def test_pieces_without_ids_do_not_gather(spark):
    pieces = packing.written(spark.range(100_000).selectExpr("CAST(null AS long) AS doc_id", "0 AS piece", "0L AS start", "1 + id % 700 AS length", "0L AS ids_crc32"), "pieces")
    found = packing.packed(pieces, "doc_id").groupBy(packing.F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(found) == 13 and max(r[1] for r in found) < 9000


@pytest.mark.parametrize("seed", range(5))
def test_improve_keeps_all_pieces(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 2049, 400).tolist()
    start = packing.best_fit(lengths, 2048)
    end = packing.improve(start, lengths, 2048)
    assert sorted(i for b in end for i in b) == list(range(400)) and len(end) <= len(start)
    assert all(sum(lengths[i] for i in b) <= 2048 for b in end)


# --- 6


def test_warc_on_odd_pages(spark, folder):
    found = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(registry.QUERIES["op6_warc"](spark, f"{folder}/odd"))), key=repr)
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in rows(spark.read.parquet(f"{folder}/odd/pages.parquet"))]
    winner = {}
    for i, p in pages:
        winner[p] = max(winner.get(p, -1), -1 if i is None else i)
    want = []
    for i, p in pages:
        revisit = winner[p] not in (-1, i)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", winner[p] if revisit else None))
    assert found == sorted(want, key=repr)


def page(payload, number=1):
    return warc.page_records(number, "0.0", "u", payload, len(payload), warc.payload_digest(payload))


def test_revisits_refer_to_records(spark, folder):
    """Every revisit names the record of a response with its payload; a payload that most pages have gathers in no archive."""
    odd = spark.read.parquet(f"{folder}/odd/pages.parquet").select("page_id", "url", "html")
    many = spark.range(20_000).selectExpr("if(id % 2 = 0, null, id) AS page_id", "'u' AS url", "'<p>gone</p>' AS html").repartition(8)
    for frame in (odd, many):
        found = {f["WARC-Record-ID"]: f for r in warc.archives(frame, "page_id", "url", "html").collect() for f, _ in warc.records(bytes(r["content"]))}
        pages = [f for f in found.values() if f["WARC-Type"] in ("response", "revisit")]
        assert len(pages) == frame.count()
        for f in pages:
            if f["WARC-Type"] == "revisit":
                to = found[f["WARC-Refers-To"]]
                assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and to["WARC-Page-ID"] != f.get("WARC-Page-ID")


def test_broken_archives_are_told():
    body = warc.chunked(b"x" * 10_000)
    assert warc.unchunked(body) == b"x" * 10_000
    with pytest.raises(ValueError):
        warc.unchunked(body[:3000])
    file = b"".join(page(b"y" * 100_000))
    fields = [f for f, _ in warc.records(file)]
    assert [f.get("WARC-Segment-Number") for f in fields] == ["1", "2", "3", "4"] and "WARC-Segment-Total-Length" in fields[-1]
    with pytest.raises(ValueError):
        list(warc.records(file[:-20]))


def test_missing_segments_are_told(spark):
    parts = list(page(b"y" * 100_000))
    for broken in (parts[:2] + parts[3:], parts[:-1], parts[1:]):
        frame = spark.createDataFrame([("a", bytearray(b"".join(broken)))], "name string, content binary")
        with pytest.raises(Exception, match="segment"):
            warc.read_pages(frame).collect()


# --- 7


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in rows(registry.QUERIES["op7_language"](spark, folder))}
    truth = [(r["doc_id"], r["lang"]) for r in rows(spark.read.parquet(f"{folder}/documents.parquet")) if r["lang"]]
    own = [found[i]["lang_pred"] == lang for i, lang in truth if found[i]["held_out"]]
    assert np.mean(own) > 0.98 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())


def test_texts_without_letters_have_no_language(spark, folder):
    found = {r["doc_id"]: r["lang_pred"] for r in rows(registry.QUERIES["op7_language"](spark, f"{folder}/odd"))}
    assert {found[i] for i in (0, 1, 2, 3, 16)} == {"und"} and found[11] == "fr"


# --- 8


def brute_top(vectors, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_on_odd_rows(spark, folder):
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(registry.QUERIES["op8_top_k"](spark, f"{folder}/odd")))
    assert found == brute_top([(r["vec_id"], r["embedding"]) for r in rows(spark.read.parquet(f"{folder}/odd/embeddings.parquet"))])


@pytest.mark.parametrize("copies", [1, 300])
def test_top_k_with_ties_in_blocks(spark, monkeypatch, copies):
    monkeypatch.setattr(topk, "VECTORS", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(1 if copies > 1 else 700, 8))
    vectors = [(i, base[i % len(base)].tolist() if i < copies * len(base) else draw.normal(size=8).tolist()) for i in range(700)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, "vec_id", "embedding", F.col("id") % 50 == 0).collect())
    assert found == brute_top(vectors)


def test_top_k_broadcasts_no_side(spark, monkeypatch):
    """Copies of queries or vectors for the other side's blocks must not come to the driver, however small a table looks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "VECTORS", 16)
    monkeypatch.setattr(topk, "HELD_BYTES", 8 * 8 * 5, raising=False)
    draw = np.random.default_rng(5)
    vectors = [(i, draw.normal(size=8).tolist()) for i in range(900)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(frame, "vec_id", "embedding", F.col("id") % 50 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == brute_top(vectors)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bounds_leave_outsiders_of_skewed_vectors():
    """Components that fall off quickly: few vectors are left long before the lists are read; nearly even ones take most of them."""
    draw = np.random.default_rng(6)
    for fall, most_left in ((0.5, 0.05), (1.0, 1.0)):
        x = np.floor(256 * draw.normal(size=(3000, 24)) * fall ** np.arange(24))
        own = np.eye(20, 3000, dtype=bool)
        left = [(read / 3000, alive.sum(axis=1).mean() / 3000) for read, alive in topk.narrowed(x[:20], np.full(20, -np.inf), x, own, 5)]
        shares = [s for _, s in left]
        assert shares == sorted(shares, reverse=True) and min(s for read, s in left if read <= 0.75) <= most_left
        q = x[:20]
        got = list(topk.block_top(np.arange(20), q, np.full(20, -np.inf), np.arange(3000), x))
        want = [(i, j, -s) for i in range(20) for s, j in sorted((-int(x[i] @ v), j) for j, v in enumerate(x) if j != i)[:5]]
        assert got == want
        # A bar from elsewhere leaves what is under it.
        high = np.array([max(s for i, _, s in want if i == k) + 1.0 for k in range(20)])
        assert not list(topk.block_top(np.arange(20), q, high, np.arange(3000), x))


def test_repeated_ids_are_one_vector(spark):
    from pyspark.sql import functions as F

    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0]), (3, [2.0, 0.0]), (3, [1.0, 0.0])]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 50 == 0).collect()
    best = min(np.floor(256 * np.array(v)).astype("<i4").tobytes() for i, v in vectors if i == 3)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 3, 256 * int(np.frombuffer(best, "<i4")[0])), (2, 1, 128 * 256), (3, 2, 64 * 256)]


# --- 9


@pytest.mark.parametrize("where", ["sf0.1", "odd"])
def test_mixture_meets_targets(spark, folder, where):
    at = f"/root/testdata/{where}" if where != "odd" else f"{folder}/odd"
    first, again = (rows(registry.QUERIES["op9_mixture"](spark, at)) for _ in range(2))
    order = lambda x: sorted(map(repr, x))
    assert order(first) == order(again)
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(SPLIT.findall(text or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    targets = dict(zip(names, plain_targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2)))
    taken = defaultdict(int)
    for r in first:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    if where != "odd":
        assert all(abs(taken[s] - targets[s]) <= 0.01 * targets[s] for s in names)


def plain_targets(sizes, weights, total, cap):
    """The level at which weights times level, capped, add up to the total, found by halving."""
    low, high = 0.0, cap * max(sizes, default=0) / min(weights, default=1) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * s, level * w) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[10, 10, 1000], [100, 300, 50], [0, 0], [], [7], list(range(1, 60))])
def test_targets_cap_and_share(spark, sizes):
    rows = [(f"s{k:03d}", n) for k, n in enumerate(sizes)]
    found = {r["_source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame(rows, "src string, size long"), "src").collect()}
    want = plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), 2)
    assert [found[n] for n, _ in rows] == pytest.approx(want)


def test_units_without_or_with_equal_ids_are_dealt_to_blocks(spark):
    frame = spark.range(60_000).selectExpr("if(id < 40000, null, 7) AS id", "'a' AS src", "10 + id % 3 AS size")
    found = mixture.mixed(frame, "id", "src", block_rows=500).groupBy().sum("copies").first()[0]
    assert abs(found - 90_000) <= 300
    counted = mixture._numbered(spark.createDataFrame([("x", 9000), ("y", 1)], "k string, n long"), "n", "i").groupBy("k").agg({"i": "max", "*": "count"})
    assert sorted(tuple(r) for r in counted.collect()) in ([("x", 8999, 9000), ("y", 0, 1)], [("x", 9000, 8999), ("y", 1, 0)])


def test_flight_keeps_totals_and_probabilities():
    import random

    draw = np.random.default_rng(2)
    sizes, prob = draw.integers(0, 900, 500), draw.random(500)
    mean = np.zeros(500)
    for seed in range(60):
        p = mixture.flight(prob, sizes, random.Random(seed))
        assert ((p > 0) & (p < 1)).sum() <= 2 and p @ sizes == pytest.approx(prob @ sizes) and p.sum() == pytest.approx(prob.sum())
        mean += p / 60
    assert np.abs(mean - prob).mean() < 0.08


def test_rounds_of_blocks(spark):
    frame = spark.createDataFrame([(i, "a" if i % 3 else None, 10 + i % 90) for i in range(3000)], "id long, src string, size long")
    found = mixture.mixed(frame, "id", "src", block_rows=50).toPandas()
    assert len(found) == 3000
    for _, part in found.groupby("src", dropna=False):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iat[0]) <= 0.01 * part["target"].iat[0]


# --- 10


def brute_near(docs):
    sets = []
    for i, text in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in SPLIT.findall(text or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = [n for n, (i, _) in enumerate(docs) if i is not None]
    for a in order:
        for b in order:
            if a < b and (sets[a] or sets[b]):
                x, y = sets[a], sets[b]
                if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                    common = len(x & y)
                    if 100 * common >= 75 * (len(x) + len(y) - common):
                        root[find(a)] = find(b)
    least = {}
    for n in order:
        least[find(n)] = min(least.get(find(n), docs[n][0]), docs[n][0])
    return sorted(((i, len(sets[n]), None if i is None else least[find(n)]) for n, (i, _) in enumerate(docs)), key=repr)


def test_near_copies_against_all_pairs(spark):
    found = rows(registry.QUERIES["op10_near_copies"](spark, "/root/testdata/sf0.01"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute_near(texts(spark, "/root/testdata/sf0.01"))


def test_near_copies_on_odd_rows(spark, folder):
    docs = texts(spark, f"{folder}/odd")
    found = rows(registry.QUERIES["op10_near_copies"](spark, f"{folder}/odd"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute_near(docs)


@pytest.mark.parametrize("settled", [16, 2])
def test_chains_of_edits_and_a_common_passage(spark, monkeypatch, settled):
    monkeypatch.setattr(near_copies, "SETTLED", settled)
    draw = np.random.default_rng(8)
    passage = [f"c{k}" for k in range(60)]
    docs, i = [], 0
    for group in range(12):
        words = [f"g{group}_{k}" for k in range(int(draw.integers(30, 160)))]
        for _ in range(14):
            words = list(words)
            for at in draw.integers(0, len(words), max(1, len(words) // 45)):
                words[at] = f"e{draw.integers(10**9)}"
            docs.append((int(i * 7919 % 1009), " ".join(words)))
            i += 1
        docs.append((2000 + group, " ".join(passage + [f"o{group}_{k}" for k in range(int(draw.integers(2, 40)))])))
    docs += [(3000 + k, " ".join(f"s{x}" for x in range(k % 6))) for k in range(18)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_copies.near_classes(frame, "doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_near(docs)


def test_large_groups_of_copies_of_one_text(spark):
    """Copies that are each near their original, but not all near each other: recall of the stars, with few centres a round."""
    draw = np.random.default_rng(12)
    base = [f"b{k}" for k in range(200)]
    docs = []
    for i in range(500):
        words = list(base)
        for at in draw.integers(0, 200, 5):
            words[at] = f"e{draw.integers(10**9)}"
        docs.append((i, " ".join(words)))
    docs.append((900, " ".join(base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: c for i, _, c in brute_near(docs)}
    found = {r[0]: r[2] for r in near_copies.near_classes(frame, "doc_id", "text").collect()}
    assert sum(found[i] == c for i, c in want.items()) >= 0.99 * len(want)


def unlike_in_one_bucket(monkeypatch):
    """Documents that all share one bucket, of which only two are similar; neither is the bucket's smallest."""
    monkeypatch.setattr(near_copies, "band_hashes", lambda sig: np.zeros(1, np.uint64))
    docs = [(i, " ".join(f"d{i}_{k}" for k in range(40))) for i in range(300)]
    return [*docs, (301, docs[207][1] + " more")]


@pytest.mark.parametrize("tile", [4096, 50])
def test_two_similar_members_of_a_large_bucket_meet(spark, monkeypatch, tile):
    docs = unlike_in_one_bucket(monkeypatch)
    monkeypatch.setattr(near_copies, "TILE", tile, raising=False)
    found = near_copies.near_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_near(docs)


@pytest.mark.parametrize("limits", [{}, {"TILE": 50}, {"WEIGHT": 4000}])
def test_pairs_of_a_large_bucket_of_nearly_similar_texts_are_no_rows(spark, monkeypatch, limits):
    """Copies of a text that is not there, each two a little less similar than it takes, but for one pair: all is found, and no table grows with the pairs."""
    draw, base, edits = np.random.default_rng(5), [f"b{k}" for k in range(200)], []
    while len(edits) < 150:
        new = set((1 + draw.choice(38, 4, replace=False)).tolist())
        if all(len(new & e) < 3 for e in edits):
            edits.append(new)
    edited = lambda i, at: " ".join(f"e{i}_{k}" if k % 5 == 2 and k // 5 in at else w for k, w in enumerate(base))
    docs = [(i, edited(i, e)) for i, e in enumerate(edits)]
    docs.append((150, docs[77][1] + " more"))
    monkeypatch.setattr(near_copies, "band_hashes", lambda sig: np.zeros(1, np.uint64))
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value, raising=False)
    counts, write = [], near_copies.written

    def counted(df, name):
        counts.append((write(df, name), name))
        return counts[-1][0]

    monkeypatch.setattr(near_copies, "written", counted)
    want = brute_near(docs)
    assert len({c for _, _, c in want}) == 150
    found = near_copies.near_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == want
    most = max((df.count(), name) for df, name in counts)
    assert most[0] <= 8 * len(docs), most


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    docs = [(1, text("a")), (5, text("a")), (5, text("b")), (5, text("b")), (7, text("b") + " more"), (8, text("c"))]
    found = near_copies.near_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r[0], r[2]) for r in found) == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (8, 8)]


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(4)
    for n in (3, 12, 60, 900):
        agree = []
        for _ in range(40):
            pool = np.unique(draw.integers(0, 2**63, 5 * n).astype(np.uint64))[: n + n // 3]
            pool = draw.permutation(pool)
            a, b = np.sort(pool[:n]), np.sort(pool[len(pool) - n :])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((near_copies.signature(a) == near_copies.signature(b)).mean() - truth)
        assert abs(np.mean(agree)) < 0.05
