"""The training-data operators against DuckDB, brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import ann, bpe, exact_dedup, language_id, minhash, packing, registry, sharding, token_counts, url_filter, warc
from quillmark.llm.transducer import Transducer, compile_words

SF = "/root/testdata/sf0.001"
DOCS = "text string, doc_id long, lang string, source string, n_chars long, id string, kept string, bands string"
LONG = "word " * 40_000
ROWS = [(None, 1), ("", 2), ("Same TEXT of a few more words here", 3), ("same text of a few more words here", 4), ("same text of a few more words here", 4), ("x", None), ("É", 5), ("é", 6), (LONG, 7), (LONG, 8), ("a  b\t<|endoftext|> c\n", 9), ("12 34 !", 10)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(t, i, "en", "s", 1, "x", "y", "z") for t, i in ROWS], DOCS)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)

    def rows(d):
        d = d[cols].astype({c: "Float64" for c in cols if pd.api.types.is_numeric_dtype(d[c]) and d[c].dtype != bool})
        return sorted(map(str, d.astype(object).where(d.notna(), None).values.tolist()))

    assert rows(got) == rows(want)


def test_exact_odd(spark, odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r for r in rows}
    assert of[1].keep_id == 2 and of[3].keep_id == 4 and of[3].group_size == 3 and not of[3].kept and of[4].kept and of[5].keep_id == 5 and of[7].keep_id == 8 and not of[None].kept
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_ann(spark):
    got = ann.op2_ann(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        assert np.allclose(g.sort_values("rank").score, sorted(s[np.searchsorted(ids, g.vec_id)], reverse=True))
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert hit >= 0.9 * len(got) and got.query_id.nunique() == (ids % 20 == 0).sum()


def test_ann_odd(spark):
    v = [1.0, 0.0]
    rows = [(i, v) for i in range(30)] + [(30, None), (31, [0.0, 0.0]), (32, [None, 1.0]), (33, [float("nan"), 1.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (None, v), (60, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, lambda i: i % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 40}
    assert got[got.query_id == 0].sort_values("rank").id.tolist() == list(range(1, 21)) and got[got.query_id == 40].sort_values("rank").id.tolist() == list(range(20))
    assert ann.nearest(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_language(spark, odd):
    got = language_id.op3_language_id(spark, SF).toPandas().set_index("doc_id")
    table = docs_of(spark).set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == table.lang[held.index]).mean() > 0.9
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index) and got.score.between(0, 1).all()
    found = {r.doc_id: r for r in language_id.identify(odd, language_id.train(odd)).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[10].lang_pred == "und" and found[3].lang_pred == "en"
    assert language_id.train(odd.limit(0)).predict(["abc"])[0] == ["und"]


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer, models

    pieces, unk = token_counts.read_pieces(token_counts.pieces_path())
    model = Tokenizer(models.Unigram(pieces, unk, True))
    rng = random.Random(1)
    texts = [t for t in docs_of(spark).text[:60] if t] + ["a  b", "\n\n x", " a\tb", "日本語 x😀", "aaaa" * 50] + ["".join(rng.choice("abe  \n\té日▁x1") for _ in range(40)) for _ in range(300)]
    counter = token_counts.counter(token_counts.pieces_path())
    assert [counter.count(t) for t in texts] == [len(model.encode("▁" + t.replace(" ", "▁")).ids) for t in texts]
    got = token_counts.count_tokens(odd, token_counts.pieces_path()).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}


def test_packing(spark, odd):
    got = packing.pack_documents(odd, bpe.tokenizer_path(), digest_only=False).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    long = got[got.doc_id == 7].sort_values("piece")
    assert (long.length[1:] == 2048).all() and b"".join(long.ids) == bpe.Encoder(bpe.tokenizer_path()).encode(LONG) + bytes(4)
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([10, 50, 300])
        counts = {rng.randint(1, size): rng.randint(1, 9) for _ in range(rng.randint(1, 20))}
        plan = packing.Plan(counts, size)
        length = np.repeat(list(counts), list(counts.values()))
        seq, offset = plan.place(length, np.concatenate([np.arange(n) for n in counts.values()]))
        rows = pd.DataFrame({"s": seq, "o": offset, "n": length}).sort_values(["s", "o"])
        assert (rows.groupby("s").n.cumsum() - rows.n == rows.o).all() and rows.groupby("s").n.sum().max() <= size


def _fewest(items, size):
    """Fewest bins, by search."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= size}:
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room + items[i]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(8)), reverse=True)
        counts = {w: items.count(w) for w in set(items)}
        fixed, rest = packing.reduce_by_dominance(counts, 12)
        left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for n, _ in fixed) + _fewest(left, 12) == _fewest(items, 12)


def test_urls(spark):
    got = url_filter.op6_url_filter(spark, SF).toPandas()
    urls = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id").url
    for r in got.itertuples():
        rest = urls[r.page_id].split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        fits = [(n, v) for n, v in url_filter.RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[0]), default=None)
        assert (r.host, r.path) == (host, path) and r.rule == (best and best[0]) and (not best or r.verdict == best[1])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no host"), (4, "HTTP://A.ORG"), (5, "http://x.com/de/1")], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(odd, url_filter.RULES).collect()}
    assert found[1].host == found[3].path == "" and found[4].host == "a.org" and found[4].rule is None and found[5].verdict == "block"


def test_url_rules(spark, tmp_path):
    """The contract's rules and words, written out, on URLs that each of them decides."""
    want = {
        1: ("http://a.org/x", "org/", "allow"),
        2: ("http://example.org/es/2", "example.org/es/", "block"),
        3: ("https://www.Example.org/en/17?page=2", "example.org/en/1", "block"),
        4: ("http://example.org/en/2", "org/", "allow"),
        5: ("http://b.com/fr/1", "com/fr/", "allow"),
        6: ("http://b.com/de/1", "com/de/", "block"),
    }
    spark.createDataFrame([(i, u, "") for i, (u, _, _) in want.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op6_url_filter(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: w[1:] for i, w in want.items()}


def test_url_counts_are_exact(spark, monkeypatch):
    """Ratios of URLs with far more distinct grams than 2^20 slots take without collisions, against plain dictionaries."""
    draw = random.Random(5)
    urls = [f"http://{draw.choice(['a.org', 'b.com', 'c.net'])}/{draw.choice(['de', 'fr'])}/" + "".join(chr(draw.randrange(33, 123)) for _ in range(60)) for _ in range(2000)]
    pages = spark.createDataFrame([*enumerate(urls), (-1, None), (-2, "")], "page_id long, url string")
    rules = [("org/", "allow"), ("com/", "block")]
    held = {r.url for r in pages.filter("pmod(xxhash64(url), 4) = 3").collect()}
    sums = {}
    for u in set(urls) - held:
        for own in [sums.setdefault(u[7:12], {})] if u[7:12] in ("a.org", "b.com") else []:
            raw = u.encode() + b"\0"
            for i in range(len(raw)):
                for k in range(min(i, 5) + 1):
                    for key in ((0, raw[i - k : i]), (1, raw[i - k : i + 1])):
                        own[key] = own.get(key, 0) + 1

    def rate(own, raw):
        logs = []
        for i in range(len(raw)):
            p = 1 / 256
            for k in range(min(i, 5) + 1):
                p = min((own.get((1, raw[i - k : i + 1]), 0) + 2 * p) / (own.get((0, raw[i - k : i]), 0) + 2), 1)
            logs.append(np.log(p))
        return np.mean(logs)

    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls) + 2 and got[-1].ratio == got[-2].ratio == 0
    for i in range(0, len(urls), 10):
        raw = urls[i].encode() + b"\0"
        assert abs(got[i].ratio - (rate(sums["a.org"], raw) - rate(sums["b.com"], raw))) < 1e-6
    monkeypatch.setattr(url_filter, "HEAD_GRAMS", 500)
    assert {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()} == got


def test_warc_odd(spark):
    rows = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "a\nb", "y"), (4, "u", "y"), (5, "u", None), (None, "u", "x" * 200), (1, "http://a/", "x" * 200), (7, "é", "\r\n\r\nWARC/1.1" * 20)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and [r.refers_to for r in got if r.page_id == 2] == [1] and sum(r.record_type == "revisit" for r in got) == 1
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in got if r.payload is not None)


def test_warc_shared_ids(spark):
    """Rows that share an id but not the payload: each is a revisit of its own payload, or a response."""
    rows = [(1, "a" * 200), (2, "b" * 200), (5, "a" * 200), (5, "b" * 200), (5, "c" * 200), (5, "d")]
    got = warc.archive_pages(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    sha = {hashlib.sha256(h.encode()).hexdigest(): h[0] for _, h in rows}
    assert sorted((r.page_id, sha[r.payload_digest], r.record_type, r.refers_to or 0) for r in got) == [(1, "a", "response", 0), (2, "b", "response", 0), (5, "a", "revisit", 1), (5, "b", "revisit", 2), (5, "c", "response", 0), (5, "d", "response", 0)]


def test_near_odd(spark, odd):
    got = minhash.near_duplicates(odd, 85).collect()
    assert len(got) == len(ROWS)
    of = {r.doc_id: r for r in got}
    assert of[1].n_shingles == 0 and of[1].kept and of[2].component_id == 2 and of[4].component_id == 3 and of[8].component_id == 7 and of[7].n_shingles == 1 and of[5].component_id == 5
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_hub(spark):
    """Copies of one text, each with another word changed: linked by way of the text itself only."""
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))] + [(i, " ".join([*base[: 8 * i + 4], f"new{i}", *base[8 * i + 5 :]])) for i in range(14)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {r.component_id for r in got.collect()} == {0}


def test_superminhash():
    x = minhash._mix(np.arange(1300, dtype=np.uint64))
    assert (minhash.superminhash(x[:40], 64) == minhash._superminhash_few(x[:40], 64)).all()
    found = [(minhash.superminhash(minhash._mix(x[:1000] + np.uint64(s)), 256) == minhash.superminhash(minhash._mix(x[100:1100] + np.uint64(s)), 256)).mean() for s in range(30)]
    assert abs(np.mean(found) - 900 / 1100) < 0.02


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.tokenizer_path())
    enc = bpe.Encoder(bpe.tokenizer_path())
    rng = random.Random(1)
    texts = [t for t, _ in ROWS if t] + ["".join(rng.choice("ab '\n\t1½é　sdl.<|_") for _ in range(40)) for _ in range(500)] + ["".join(chr(rng.randrange(32, 0xD7FF)) for _ in range(40)) for _ in range(200)]
    for t in texts:
        ids = model.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids and enc.decode(enc.encode(t)).decode() == model.decode(ids, skip_special_tokens=False)
        word = t.encode()[:200]
        assert enc.model.merge(word) == enc.model.merge_here(word) if word else True
    got = bpe.encode_documents(odd, bpe.tokenizer_path()).collect()
    assert len(got) == len(ROWS) and all(r.decoded == (dict((i, t) for t, i in ROWS)[r.doc_id] or "") for r in got if r.doc_id != 4)
    words = [(b"abc", (1, 2)), (b"abd", (1, 3)), (b"ab", (1,)), (b"xbd", (7,)), (b"xbc", ()), (b"z", (9, 9))]
    lexicon = Transducer(compile_words(words))
    assert all(lexicon.get(w) == list(o) for w, o in words) and lexicon.get(b"a") is None


def test_sharding(spark, odd):
    def jump(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
            j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
        return b

    rng = random.Random(1)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 24).alias("a")).collect()
    assert all(r.a == jump(r.k, 24) for r in rows)
    got = sharding.op10_sharding(spark, SF).toPandas()
    text = docs_of(spark).set_index("doc_id").text
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8 and r.shard == jump(r.doc_id, 24) and r.grown_shard in (r.shard, 24) for r in got.itertuples())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.assign_shards(odd, 3).count() == len(ROWS)


def test_pipeline(spark):
    table = docs_of(spark)
    got = corpus_pipeline.run(spark, SF).toPandas()
    kept = table[[language_id.has_letter(t) for t in table.text]]
    kept = kept.assign(low=[t.encode().lower() for t in kept.text]).sort_values("doc_id").drop_duplicates("low", keep="last")
    sets = {i: set(minhash.shingle_set(t).tolist()) for i, t in zip(kept.doc_id, kept.text, strict=True)}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    assert set(got.doc_id) == {i for i in ids if root(i) == i}


def test_pipeline_ids(spark, monkeypatch):
    """Rows with null or shared ids go by their own texts: copies without id go, texts that only share an id stay."""
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in (0, 59)]
    rows = [(None, "One text"), (1, "one text"), (None, "alone"), (None, "alone"), (2, "first of two"), (2, "second of two"), (3, "second of two"), (4, "repeated"), (4, "repeated"), (5, near[0]), (5, "clean"), (None, near[1]), (6, None)]
    docs = spark.createDataFrame([(t, i, "en", "s", 1, "x", "y", "z") for i, t in rows], DOCS)
    for sent in (corpus_pipeline.BROADCAST_ROWS, 0):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", sent)
        left = corpus_pipeline.exact_stage(spark, docs, SF)
        want = [(1, "one text"), (None, "alone"), (2, "first of two"), (3, "second of two"), (4, "repeated"), (5, near[0]), (5, "clean"), (None, near[1]), (6, None)]
        assert left.columns == docs.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in left.collect())
        left = corpus_pipeline.near_stage(spark, left, SF)
        want.remove((None, near[1]))
        assert left.columns == docs.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in left.collect())
    both = spark.createDataFrame([(near[0], None, "en", "s", 1, "x", "y", "z"), (near[1], None, "en", "s", 1, "x", "y", "z")], DOCS)
    assert corpus_pipeline.near_stage(spark, both, SF).count() == 1


@pytest.mark.parametrize("lang", [None, "en"])
def test_pipeline_language(spark, lang):
    """Null and letterless texts go whether or not any document has a language."""
    docs = spark.createDataFrame([(t, i, lang, "s", 1, "x", "y", "z") for t, i in ROWS], DOCS)
    left = corpus_pipeline.language_stage(spark, docs, SF)
    assert left.columns == docs.columns and sorted(str(r.text) for r in left.collect()) == sorted(t for t, _ in ROWS if language_id.has_letter(t))
