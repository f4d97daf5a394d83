import hashlib
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from reelspark.llm import fingerprints, language_id, mixing, packing, quality_rules, secret_scans, url_filters, warc
from reelspark.llm.common import hash_below, small_batches
from tests.conftest import SMALL
from tests.llm.data import DOCS, docs, hard_cases
from tests.llm.test_pairs import brute_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int"


def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(i + 10_000, t) for i, t in hard_cases()]


@pytest.mark.parametrize("name", ["op4_url_filters", "op5_substring_dedup", "op9_ngram_jaccard", "op10_warc", "op11_importance", "op13_source_audit"])
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.COM/en/1", "x://b.com?/en/", "x://com/en/", "x://notexample.com/en/7", "x://example.com/en/77#f", "x://s.example.net/de/8/", "x://example.net/de/9"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, None, "y")], "page_id bigint, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, url_filters.rules_table(spark)).collect()}
    assert got[0] == ("", "", None, "allow") and got[4] == ("a.com", "/en/1", "com/en/", "block") and got[5] == ("b.com", "", None, "allow")
    assert got[6][2] == "com/en/" and got[7][2] == "com/en/" and got[8][2:] == ("example.com/en/7", "allow")
    assert got[9][2:] == ("example.net/de/8", "block") and got[10][2:] == ("net/de/", "allow")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filters.judge(pages, none).collect()} == {"allow"}


def test_quality_statistics(spark):
    rows = small(spark)
    got = {r.doc_id: r for r in quality_rules.quality(docs(spark, rows, clash=True), spark.createDataFrame([(0, 1, 0)], LABELS)).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(windows)
        twice = {x for x in windows if times[x] > 1}
        inside = {k + d for k, x in enumerate(windows) if x in twice for d in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.quality(none, spark.createDataFrame([], LABELS)).count() == 0


def test_quality_threshold_reads_both_labels():
    counts = [(1900, 0, 3), (1900, 1, 1), (1500, 0, 1), (1200, 1, 30), (900, 0, 1), (900, 1, 69)]
    assert quality_rules.best_threshold(counts) == 1500 / quality_rules.BINS
    assert quality_rules.best_threshold([(1800, 0, 1), (900, 1, 4)]) == 1800 / quality_rules.BINS
    assert quality_rules.best_threshold([(900, 0, 2), (1800, 1, 2)]) == float("inf")
    assert quality_rules.best_threshold(counts[:1]) == quality_rules.best_threshold([(5, 1, 9)]) == quality_rules.best_threshold([]) == float("inf")


@pytest.mark.parametrize("part", [0, 1])
def test_quality_recalls_held_out_junk(spark, part):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality(d, labels.where(f"pmod(hash(doc_id), 2) = {part}"))
    held = got.where("not base_failed").join(labels.where(f"pmod(hash(doc_id), 2) <> {part}"), "doc_id")
    shares = {r.quality: r.gone for r in held.groupBy("quality").agg(F.avg(F.expr("if(kept, 0, 1)")).alias("gone")).collect()}
    assert shares[0] >= 0.95 and shares[1] <= 0.1, shares


def test_fingerprints(spark):
    rows = sorted(small(spark))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows, clash=True).repartition(3)).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (t == after) and (r.fingerprint == r.edited_fingerprint) == (t == edited)
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    rows = small(spark) + [(20_000, "Don't \"s' <|endoftext|> x.y/z it's é. É,a \u0301 e\u0301"), (20_001, "<|startoftext|>A <|EndOfText|>b<|endoftext|>"), (20_002, "w" * 100_000)]
    got = packing.pack_documents(docs(spark, rows, clash=True).repartition(2)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and r.length == len(r.ids) for r in pieces)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048 and len(own) <= packing.SEGMENTS
    assert sum(sum(r.length for r in own) < 2048 for own in by_sequence.values()) <= 4
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    plain = packing.pack_documents(docs(spark, rows[-3:]), plain=True).collect()
    tokenizer.encode_special_tokens = True
    for i, t in rows[-3:]:
        assert [x for r in sorted((r for r in plain if r.doc_id == i), key=lambda r: r.start) for x in r.ids] == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


class Counting:
    """A tokenizer that counts the strings and the characters it gets in batches."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings, self.characters = tokenizer, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.strings += len(texts)
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def one_text(words):
    return pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], names=["text"])


def test_packing_learns_each_word_once_and_many_at_a_time():
    encoder = packing.WordIds(packing.TOKENIZER)
    encoder.tokenizer = count = Counting(encoder.tokenizer)
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [f"x{k:06}".translate(letters) for k in range(240_000)]
    got = [encoder.of(one_text(words[a : a + 60_000])) for a in [*range(0, 240_000, 60_000)] * 2]
    assert all((x[0] == y[0]).all() for x, y in zip(got[:4], got[4:], strict=True))
    assert count.strings <= 5_000 and count.characters <= 240_000 * 8
    encoder.of(one_text(f"{words[k]}{k}.{words[k]}" for k in range(5_000)))  # numbers make no new words
    assert count.characters <= 240_000 * 8 + 2


def test_packing_ids_beside_digits_and_after_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    monkeypatch.setattr(packing, "KNOWN_IDS", 90, raising=False)
    tokenizer, encoder = Tokenizer.from_file(packing.TOKENIZER), packing.WordIds(packing.TOKENIZER)
    atoms = [*"0123456789abXY'.=<_-", "'s", "don't", "\u0301", "\u0338", "\u20e3", "\u00a0", "\u0085", "\u1100", "\u1161", "é", "Σ", "²", "０", "😀", " ", "\n"]
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = [None, "", "0", "00 0", *("".join(rng.choice(atoms, n)) for n in rng.integers(1, 40, 60))]
        ids, edges = encoder.of(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
        assert [x.tolist() for x in np.split(ids, edges[1:-1])] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_packing_examples_under_three_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(n), int(rng.integers(0, min(n, 600)))) for k, n in enumerate(rng.integers(1, 900, 500))]
    df = spark.createDataFrame(rows, "example_id bigint, n_tokens bigint, n_loss bigint").repartition(2)
    placed = packing.pack_examples(df, 1000, 4, 600).collect()
    assert sorted(r.example_id for r in placed) == list(range(500))
    for s in {r.sequence_id for r in placed}:
        own = [rows[r.example_id] for r in placed if r.sequence_id == s]
        assert sum(x[1] for x in own) <= 1000 and len(own) <= 4 and sum(x[2] for x in own) <= 600
    beyond = spark.createDataFrame([(1, 2000, 5), (2, 900, 700), (3, None, 1), (4, 10, 10)], df.schema)
    assert sorted((r.example_id, r.sequence_id is None) for r in packing.pack_examples(beyond, 1000, 4, 600).collect()) == [(1, True), (2, True), (4, False)]


def test_language_on_held_out_rows(spark):
    out = entry.queries()["op1_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    rows = out.where("held_out").collect()
    assert rows and sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


def test_language_sums_all_segmentations():
    hashes = np.unique(np.array([language_id.hash_of(p) for p in ("▁", "▁a", "a", "b", "ab", "▁ab")], np.uint64))
    p = np.random.default_rng(0).random((len(hashes) + 1, 2))
    p[-1] = 0
    prob = lambda piece, k: p[int(np.searchsorted(hashes, np.uint64(language_id.hash_of(piece)))), k]
    model = language_id.Model(["x", "y"], hashes, p)

    def brute(word, k):
        return 1.0 if not word else sum(prob(word[:n], k) * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in ("▁", "▁a", "a", "b", "ab", "▁ab"))

    words = ["ab", "aab", "b", "abab"]
    assert np.allclose(language_id.word_scores(words, model), [[np.log(brute("▁" + w, k)) for k in (0, 1)] for w in words])


def test_language_edges(spark):
    rows = hard_cases()
    model = language_id.fit(docs(spark, rows).where("lang is not null and text is not null"))
    got = {r.doc_id: r for r in language_id.predict(docs(spark, rows, clash=True), model).collect()}
    assert all(got[i].lang_pred == "und" for i in (2, 3, 4, 14)) and got[0].lang_pred in ("en", "fr")
    assert language_id.predict(docs(spark, rows), None).where("lang_pred <> 'und'").count() == 0


def test_samples_and_batches_at_any_size():
    assert 0 < hash_below(8192, 10**11) < 1 << 62 and hash_below(8192, 10) == 1 << 62 and hash_below(1500, 10**17) > 0
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 50_000)], names=["text"])
    parts = [b.num_rows for b in small_batches([batch], most_rows=500)]
    assert sum(parts) == 50_000 and max(parts) <= 500


def test_language_of_a_very_long_word(spark):
    rows = [(1, "the word " * 30 + "ab" * 10_000), (2, "das wort " * 30), (3, "x" * 5_000)]
    labelled = spark.createDataFrame([(1, rows[0][1], "en"), (2, rows[1][1], "de")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs(spark, rows), language_id.fit(labelled)).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] in ("en", "de")


def test_language_learns_every_value(spark):
    labelled = spark.createDataFrame([(k, f"only{k} words{k} here{k} " * 5, f"l{k:03d}") for k in range(520)], "doc_id bigint, text string, lang string")
    assert len(language_id.fit(labelled).languages) == 520


def test_mixing_many_short_texts_and_null_ids(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], LABELS)
    texts = spark.createDataFrame([(k if k < 20_000 else None, f"{'good' if k % 2 else 'bad'} w{k % 50}") for k in range(21_000)], "doc_id bigint, text string")
    rows = mixing.mix(texts, labels, targets={"q0t0": 0.25, "q1t0": 0.75}).collect()
    assert len(rows) == 21_000 and len({r.copies for r in rows if r.doc_id is None and 0.2 < r.rate % 1 < 0.8}) > 1


def test_mixing_meets_targets(spark):
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(d, labels).collect()
    p = np.array([r.posteriors for r in rows])
    n = np.array([r.n_tokens for r in rows])
    total = (p * (n * np.array([r.rate for r in rows]))[:, None]).sum(axis=0) / n.sum()
    domains = sorted({f"q{r.quality}t{r.toxic}" for r in labels.join(d, "doc_id").collect()})
    want = np.array([mixing.TARGETS[x] for x in domains])
    assert np.abs(total - want / want.sum()).max() < 0.01 and min(r.rate for r in rows) >= 0
    none = spark.createDataFrame([], LABELS)
    assert {r.rate for r in mixing.mix(docs(spark, hard_cases(), clash=True), none).collect()} == {1.0}
    assert mixing.mix(spark.createDataFrame([], DOCS), none).count() == 0


def test_mixing_stage_meets_targets_by_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    targets = {"q1t0": 0.5, "q0t0": 0.4, "q1t1": 0.06, "q0t1": 0.04}
    model = mixing.fit_classifier(d, labels, mixing.DOMAIN)
    got = mixing.thin(d, labels, targets=targets).cache()
    total = np.sum([r.n_tokens * np.array(r.posteriors) for r in mixing.posteriors(got, model).collect()], axis=0)
    want = np.array([targets[x] for x in model.domains])
    assert np.abs(total / total.sum() - want / want.sum()).max() < 0.03, (model.domains, total / total.sum())
    assert got.exceptAll(d).count() > 0 and got.select("doc_id").subtract(d.select("doc_id")).count() == 0


def test_rates_that_miss_are_told(spark):
    known = spark.createDataFrame([(k, 100, [1.0, 0.0]) for k in range(5)], "doc_id bigint, n_tokens bigint, posteriors array<double>")
    with pytest.warns(UserWarning, match="miss their targets by 0.5"):
        mixing.fit_rates(known, np.array([250.0, 250.0]))


def test_secrets(spark):
    forest = secret_scans.train(secret_scans.labelled_findings(spark))
    key = hashlib.sha256(b"k").hexdigest()[:40]
    rows = hard_cases() + [(30, f'Er said token = "{key}" and commit {key} then 2669109448945250.'), (31, "x" * 50_000 + "1")]
    found = {r.doc_id: r for r in secret_scans.scan(docs(spark, rows, clash=True), forest, "source").collect()}
    assert found[30]._redacted == rows[-2][1].replace(f'"{key}"', '"[SECRET]"') and len(found[30]._findings) == 3
    assert found[2]._findings is None and found[2]._redacted is None and all(found[i]._redacted == t for i, t in rows if i not in (2, 30))
    clash = docs(spark, rows).selectExpr("*", "1 as _c", "2 as _findings", "3 as _secret", "4 as _redacted", "5 as _gaps", "6 as __c")
    again = secret_scans.redact(clash, forest, "source")
    assert again.columns == clash.columns and {r.doc_id: r.text for r in again.collect()} == {i: r._redacted for i, r in found.items()}
    assert {tuple(r[5:]) for r in again.collect()} == {(1, 2, 3, 4, 5, 6)}
    assert secret_scans.scan(docs(spark, rows).limit(0), forest).count() == secret_scans.redact(clash.limit(0), forest).count() == 0
    with pytest.raises(ValueError, match="_secret"):
        secret_scans.scan(clash, forest)
    held = secret_scans.labelled_findings(spark, 9000).where("abs(hash(c)) % 3 = 0").selectExpr("c", "concat('aa ', before, c, after, ' bb') as text", "path", "label")
    judged = secret_scans.scan(held, forest, "path").selectExpr("label", "exists(_secret, s -> s) as said").groupBy("label", "said").count().collect()
    right = sum(r["count"] for r in judged if bool(r.label) == bool(r.said))
    assert right >= 0.95 * sum(r["count"] for r in judged)


def test_secrets_without_digits_short_or_with_punctuation(spark):
    rng = random.Random(7)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    low, letters = string.ascii_lowercase, string.ascii_letters
    strong = lambda n: "a" + some(letters + string.digits + ".@!:$", n - 2) + "7"
    secrets, others = [], []
    for k in range(40):
        secrets += [(f'api_key = "{v}"', v) for v in [some(letters, 20), some(letters, 24)]]
        secrets += [(f"{w}{v}", v) for w, v in [("password = ", some(letters + string.digits, 8 + k % 8)), ("passwd: ", strong(8 + k % 8)), ("token=", strong(20))]]
        secrets += [(f'"password":"{v}"', v) for v in ["-".join(some(low, 5) for _ in range(4))]]
        secrets += [(f"https://user:{v}@host.org/x", v) for v in [some(letters + string.digits, 9)]]
        others += [f"the key: {some(low, 9)} is here", f"{some(low, 18)} word", f"password = os.environ[{some(low, 5)}]", f"see /{some(low, 7)}/{some(low, 6)}-{some(low, 6)} now"]
    rows = [(k, t) for k, t in enumerate([f"Er said {t} and left" for t, _ in secrets] + others)]
    found = {r.doc_id: r for r in secret_scans.scan(docs(spark, rows), secret_scans.train(secret_scans.labelled_findings(spark)), "source").collect()}
    assert all(v in [x.c for x in found[k]._findings] for k, (_, v) in enumerate(secrets))
    struck = [found[k]._redacted == rows[k][1].replace(v, "[SECRET]") for k, (_, v) in enumerate(secrets)]
    assert all(sum(struck[k::7]) >= 34 for k in range(7)), [sum(struck[k::7]) for k in range(7)]
    wrong = [t for k, t in enumerate(others, len(secrets)) if any(found[k]._secret)]
    assert len(wrong) <= 0.05 * len(others), wrong


def test_warc_round_trip(spark, tmp_path):
    big, small_ = "é" * 600, "x"
    rows = [(1, "http://a/1", big), (2, "http://a/2\n", big), (3, None, None), (4, "http://a/4", small_), (5, "u", small_), (6, "v", big + "1")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)
    folder = f"file://{tmp_path}"
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes, got[1].payload) == ("revisit", 2, 1200, None)
    assert bytes(got[2].payload) == big.encode() and got[2].record_type == "response" and got[2].url == "http://a/2%0A"
    assert bytes(got[3].payload) == b"" and got[3].url is None and {got[4].record_type, got[5].record_type, got[6].record_type} == {"response"}
    assert [r.page_id for r in warc.read_records(index.where("page_id = 6"), folder).collect()] == [6]
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_warc_archives_are_valid(spark, tmp_path):
    rows = [(1, "http://a/1", "é" * 600), (2, "http://a/2", "é" * 600), (3, "", ""), (3, "http://a/3", "y" * 2000), (3, "http://a/3", "y" * 2000), (4, "http://a/4: x", None)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), f"file://{tmp_path}")
    members = {(r.archive, r.offset): r for r in index.collect()}
    kinds, ids = [], {}
    for path in tmp_path.glob("*.warc.gz"):
        data = path.read_bytes()
        at = 0
        while at < len(data):  # gzip members one after the other, as the index says
            z = zlib.decompressobj(31)
            text = z.decompress(data[at:])
            size = len(data) - at - len(z.unused_data)
            assert members[path.name, at].length == size
            at += size
            head, rest = text.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            assert lines[0] == "WARC/1.1" and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            http, body = rest[:-4].split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200") and fields["WARC-Record-ID"].startswith("<urn:uuid:") and fields["Content-Type"].startswith("application/http")
            kinds.append((int(fields["X-Page-ID"]), fields["WARC-Type"]))
            ids[kinds[-1][0]] = fields["WARC-Record-ID"]
            if fields["WARC-Type"] == "response":
                assert hashlib.sha1(body).hexdigest() == fields["WARC-Payload-Digest"].removeprefix("sha1:")
            else:
                assert body == b"" and fields["WARC-Refers-To"] == ids.get(2, fields["WARC-Refers-To"])
    assert sorted(kinds) == [(1, "revisit"), (2, "response"), (3, "response"), (3, "response"), (3, "response"), (4, "response")]
    got = warc.read_records(index, f"file://{tmp_path}").collect()
    assert sorted((r.page_id, r.url, r.payload_bytes) for r in got if r.page_id > 2) == [(3, "", 0), (3, "http://a/3", 2000), (3, "http://a/3", 2000), (4, "http://a/4: x", 0)]


def awkward(spark, rows):
    """Documents with repeated rows, null ids and columns whose names the operators might use."""
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(rows + rows[:5] + [(None, rows[0][1], "en", "src", 3)], DOCS)
    return df.selectExpr("*", *(f"'x' as `{n}`" for n in ("n", "cls", "fp", "first", "label", "kept", "_c", "_secret", "_findings", "score", "copies", "rate")))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, tmp_path, empty):
    """Each stage on its predecessor's rows: near duplicates and packing by brute force, quality and
    secrets by their operators' rows, mixing by whole rows (its totals have a test of their own)."""
    rows = small(spark) + [(20_000, f"A key: password = \"{hashlib.sha256(b'q').hexdigest()[:24]}\" " + " ".join(f"v{k}" for k in range(80)))]
    df = awkward(spark, rows).limit(0 if empty else 10**6)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages, all_rows = dict(corpus_pipeline.STAGES), lambda d: Counter(map(tuple, d.collect()))
    at = df.columns.index("text")

    good = stages["quality"](spark, df, str(tmp_path)).cache()
    kept = {(r.doc_id, r.n_words) for r in quality_rules.quality(df, labels).where("kept").collect()}
    assert good.columns == df.columns and not all_rows(good) - all_rows(df)
    assert {(r.doc_id, len(WORD.findall(r.text or ""))) for r in good.collect()} == kept

    unique = stages["near_duplicates"](spark, df, str(tmp_path)).cache()
    label = {i: c for i, _, c in brute_jaccard({r.doc_id: r.text for r in df.collect() if r.doc_id is not None}.items())}
    assert unique.columns == df.columns and all_rows(unique) == Counter({r: n for r, n in all_rows(df).items() if r[0] is None or label[r[0]] == r[0]})

    clean = stages["secrets"](spark, good, str(tmp_path)).cache()
    found = secret_scans.scan(good.select("doc_id", "text", "source"), secret_scans.train(secret_scans.labelled_findings(spark)), "source")
    assert clean.columns == df.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r.doc_id, r._redacted) for r in found.collect())
    assert all(r.n_chars == len(r.text) for r in clean.where("doc_id is not null").collect()) and (empty or any("[SECRET]" in r.text for r in clean.collect()))

    mixed = stages["mixing"](spark, clean, str(tmp_path)).cache()
    assert mixed.columns == df.columns and set(all_rows(mixed)) <= set(all_rows(clean))

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    pieces: dict = {}
    for r in stages["packing"](spark, mixed, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, Counter())[r.start, tuple(r.ids)] += 1
    want: dict = {}
    for r in mixed.collect():
        want.setdefault(r.doc_id, Counter()).update(Counter([*tokenizer.encode(r[at] or "", add_special_tokens=False).ids, 1]))
    assert {i: sum((Counter({x: n * c.count(x) for x in set(c)}) for (_, c), n in own.items()), Counter()) for i, own in pieces.items()} == want
