"""Personal data, quality rules, media, sharding and WARC archives."""

import base64
import hashlib
import random
import re
import struct
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import media as M
from sheafwork.llm import pii as P
from sheafwork.llm import queries
from sheafwork.llm import quality as Q
from sheafwork.llm import sharding as H
from sheafwork.llm import warc as W

from .helpers import AWKWARD, documents, plain_documents

# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checksum = sum((d := int(c) * (2 if k % 2 else 1)) - (9 if d > 9 else 0) for k, c in enumerate(reversed(digits)))
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and checksum % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    random.seed(5)
    parts = ["1", "23", "255", "4111111111111111", ".", "@", "a", "b-c", "+", " ", "-", "(", ")", ".com", "%", "é", "٣", "+1 (310) 555-4510"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert P.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_take_linear_time(model):
    """Ten times the text may take thirty times as long, not a hundred times."""
    for part, n in (("a", 40_000), ("1", 20_000), ("+1", 5_000), ("1 ", 2_000), ("@", 10_000), ("a1b ", 3_000), ("x@y.", 2_000)):
        took = []
        for k in (1, 10):
            began = time.process_time()
            P.all_spans(part * (n * k), model)
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.5, part


@pytest.fixture(scope="module")
def model():
    return P.SegmentModel.train(P.seed_examples())


def test_model_adds_spans_and_keeps_base_ones(model):
    found = lambda t: [(k, t[a:b]) for a, b, k in P.all_spans(t, model)[1]]
    assert found("please call (310) 555-4510 now") == [("phone", "(310) 555-4510")]
    assert found("write to joe [at] mail [dot] com today") == [("email", "joe [at] mail [dot] com")]
    assert found('set token = "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3" here') == [("secret", "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3")]
    for clean in ("in 2024-01-02 there were 1,234,567 of them", "version 10.2.3 costs 25.50", "no address is 300.1.2.3 here", "plain words only"):
        assert found(clean) == []
    both = "a@b.co +1 (310) 555-4510 4111 1111 1111 1111"
    base, spans = P.all_spans(both, model)
    assert set(base) <= set(spans)


def test_secrets_and_addresses_without_a_near_trigger(model):
    """No two digits stand together, or the whole is longer than the context around a trigger."""
    found = lambda t: [(k, t[a:b]) for a, b, k in P.all_spans(t, model)[1]]
    for secret in ("qWeRtYuIoPaSdFgHjKlZxCvB", "a1Bc2De3Fg4Hi5Jk6Lm7No8Pq9Rs0TuV", "Zx9" + "aBcDeFgH" * 4 + "12" + "kLmNoPqR" * 4):
        for form in ("set token = {} here", "my api key: {} is", "password={}"):
            assert found(form.format(secret)) == [("secret", secret)], form.format(secret)
    address = "somebodyelse.withaverylongfamilyname.of.thehouse[at]mail[dot]example"
    assert found(f"write to {address} now") == [("email", address)]
    assert found("internationalization of counterrevolutionaries and uncharacteristically long words") == []
    for text in ("a" * 400_000, "ab12" * 50_000, "@ " * 50_000, "x" * 200_000 + " 12"):
        assert all(0 <= a < b <= len(text) for a, b in P.regions(text))


def tokens_of(text, start, end):
    """Bounds of the tokens: runs of letters and digits, of white space, and single characters."""
    out, at = [], start
    while at < end:
        kind = lambda c: "w" if c.isalnum() else "s" if c.isspace() else c
        stop = at + 1
        while kind(text[at]) in "ws" and stop < end and kind(text[stop]) == kind(text[at]):
            stop += 1
        out.append((at, stop))
        at = stop
    return out


def possible(tokens):
    """Whether these tokens may be one entity: numbers and their marks, or an address, without white space but single blanks."""
    numeric = lambda t: t in " ().+-" or t.isascii() and t.isdigit()
    if not (tokens[0][0].isalnum() or tokens[0] in "+(") or not tokens[-1][-1].isalnum() or len(tokens) > P.MAX_TOKENS:
        return False
    for n in range(1, len(tokens) + 1):
        own = tokens[:n]
        if own[-1].isspace() and own[-1] != " ":
            return False
        if n > 1 and not all(map(numeric, own)) and not {"@", "at"} & set(own) and own[-1] not in set(" .[(_-+%") and not own[-1][0].isalnum():
            return False
    return all(map(numeric, tokens)) or bool({"@", "at"} & set(tokens)) or len(tokens) == 1 and len(tokens[0]) >= 16


def plain_segmentation(text, start, end, model):
    """The best of all segmentations by trying every one; of equal scores the one whose last choices are plain, then long."""
    bounds = tokens_of(text, start, end)
    words = [text[a:b] for a, b in bounds]
    known = {0: (0.0, ())}

    def best(j):
        if j not in known:
            t = words[j - 1]
            name = "digits" if t[0].isdigit() else "@" if t == "@" else "long" if len(t) >= 16 else "word"
            top = (best(j - 1)[0] + model.weights.get(f"plain:{name}", 0.0), best(j - 1)[1])
            for i in range(j):
                if possible(words[i:j]):
                    for kind, names in P.span_features(text, bounds[i][0], bounds[j - 1][1]).items():
                        score = best(i)[0] + sum(model.weights.get(x, 0.0) for x in names)
                        if score > top[0]:
                            top = (score, (*best(i)[1], (bounds[i][0], bounds[j - 1][1], kind)))
            known[j] = top
        return known[j]

    for j in range(len(bounds) + 1):
        best(j)
    return list(best(len(bounds))[1])


PARTS = ["call", "(310) 555-4510", "12.5", "4111 1111 1111 1111", "x@y.zz", "joe [at] mail [dot] com", "7", "+1 310", "key:", "\n", "a1b2c3d4e5f6a7b8c9d0e1f2", "10.2.3.4", "at", "(", "2024-01-02"]


def test_decoding_is_the_best_segmentation(model):
    random.seed(8)
    untrained = P.SegmentModel()  # ties everywhere
    for _ in range(400):
        text = " ".join(random.choice(PARTS) for _ in range(random.randint(1, 6)))
        for one in (model, untrained):
            assert one.decode(text, 0, len(text)) == plain_segmentation(text, 0, len(text), one), repr(text)
    text = " ".join("12 34 56 (7) 8-9".split() * 20)  # many times longer than an entity can be
    assert model.decode(text, 0, len(text)) == plain_segmentation(text, 0, len(text), model)


def test_spans_equal_brute_force(spark, model):
    """End to end: the base patterns, and the best segmentation of every region where it meets no base span."""
    random.seed(18)
    texts = [" ".join(random.choice([*PARTS, "plain words between them"]) for _ in range(random.randint(0, 30))) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"] and re.search("[0-9]{2}|@", r["text"])]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    found = {r["doc_id"]: r["spans"] for r in P.find_personal_data(documents(spark, rows), model).collect()}
    n_added = 0
    for k, t, _ in rows:
        base = plain_spans(t)
        more = [x for a, b in P.regions(t) for x in plain_segmentation(t, a, b, model)]
        more = [x for x in more if not any(x[0] < e and s < x[1] for s, e, _ in base)]
        n_added += len(more)
        assert found[k] == P.spelled(sorted([*base, *more], key=lambda x: (x[0], P.KINDS.index(x[2]), x[1])))
    assert n_added > 40


def test_long_numbers(spark, model):
    """Numbers of any length through Spark; leading zeros count as the number they spell."""
    long_ip = "x 1.2.3." + "0" * 10_000 + "1 y"
    rows = [(1, long_ip, "en"), (2, "9" * 100_000, "en"), (3, "1." * 50_000, "en"), (4, "0" * 9000 + "256.1.1.1", "en"), (5, "12 " * 20_000, "en")]
    found = {r["doc_id"]: r for r in P.personal_data_report(documents(spark, rows)).collect()}
    assert (found[1]["n_ip"], found[4]["n_ip"]) == (1, 0) and found[1]["spans"].startswith(f"ip:2:{len(long_ip) - 2}")
    assert found[3]["n_ip"] == 12_500 and len(found) == 5
    assert P.base_spans("a 1 2 " + "3" * 300_000) == []


def test_a_long_region_takes_little_memory(model):
    """1 MB of digit pairs is one region; what is held for it are a few numbers a token."""
    text = "12 34 " * 170_000
    assert list(P.regions(text)) == [(0, len(text))]
    tracemalloc.start()
    try:
        assert P.base_spans(text) == []
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        model.decode(text, 0, 30_000)  # a fixed part and 16 bytes a token: 200 MB would be room for regions of 6 million characters
        assert tracemalloc.get_traced_memory()[1] - held < 1 << 20
    finally:
        tracemalloc.stop()


def test_personal_data_rows(spark, model):
    rows = [*AWKWARD, (20, "mail a.b@c.example now, ip 1.2.3.4, card 4111 1111 1111 1111, phone +1 (310) 555-4510", "en")]
    found = P.personal_data_report(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        base = plain_spans(text or "")
        assert [r[f"n_{k}"] for k in P.BASE_KINDS] == [sum(s[2] == k for s in base) for k in P.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(P.spelled(base).encode()).hexdigest()
        assert {P.spelled([s]) for s in base} <= set(r["spans"].split(","))
    assert P.personal_data_report(documents(spark, [])).count() == 0


def test_redaction_leaves_no_base_span(spark, model):
    docs = plain_documents(spark, [(1, "mail a.b@c.example, ip 1.2.3.4 and token = \"" + "ab12" * 10 + '"', "en"), (2, None, None)])
    found = {r["doc_id"]: r["text"] for r in P.redacted_texts(docs, model).collect()}
    assert found == {1: 'mail [EMAIL], ip [IP] and token = "[SECRET]"', 2: None}


# quality rules


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(windows)
    covered = {k + j for k, g in enumerate(windows) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(spark):
    random.seed(1)
    rows = list(AWKWARD)
    for k in range(80):
        n = random.choice([3, 10, 120])
        rows.append((100 + k, "".join(random.choice(["a", "b", "c", "dé"]) + random.choice([" ", " ", "\n", "\t", "  \n"]) for _ in range(n)), "en"))
    found = Q.quality_report(documents(spark, rows)).collect()
    want = [(i, *plain_quality(t)) for i, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:-1]) for r in found)
    assert all(not (r["base_failed"] and r["kept"]) for r in found)
    assert Q.quality_report(documents(spark, [])).count() == 0


def test_windows_with_equal_hashes_are_compared(spark, monkeypatch):
    """Two bits of hash only, or room for four places: unequal windows meet, and texts decide."""
    random.seed(29)
    texts = [" ".join(random.choice("abcde") for _ in range(n)) for n in (3, 4, 5, 6, 9, 30, 90) for _ in range(6)]
    texts += ["a b c a b c", "a a a a", " ".join(map(str, range(200))), " ".join(map(str, range(200))) + " 7 8 9"]
    for places in (1 << 62, 4, 1):
        monkeypatch.setattr(Q, "_PLACES", places)
        found = documents(spark, [(k, t, "en") for k, t in enumerate(texts)]).select("doc_id", Q.text_statistics(F.col("text"))["n_repeat_words"]).collect()
        assert [n for _, n in sorted(map(tuple, found))] == [plain_quality(t)[4] for t in texts]


def plain_kept(text):
    """All rules, one after another."""
    text = text or ""
    words, chars, symbols, dups, repeated, failed = plain_quality(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    capitals, letters = (sum(unicodedata.category(c).startswith(k) for c in text) for k in ("Lu", "L"))
    return not (failed or symbols * 10 > words or dups * 5 > len(lines) * 2 or chars < 2 * words or chars > 20 * words or capitals * 5 > chars * 2 or letters * 20 < chars * 11)


def quality_rows():
    """Texts around every rule's limit."""
    random.seed(23)
    rows = list(AWKWARD)
    vocabulary = [random_name(k) for k in range(500)]
    for k in range(120):
        words = [random.choice(vocabulary) for _ in range(random.choice([48, 49, 50, 51, 120]))]
        kind = k % 7
        if kind == 1:
            words = [w + "#" * (random.random() < 0.12) for w in words]
        elif kind == 2:
            words = [w.upper() if random.random() < 0.45 else w for w in words]
        elif kind == 3:
            words = [str(random.randrange(10**5)) if random.random() < 0.5 else w for w in words]
        elif kind == 4:
            words = [w[: random.choice([1, 2, 3])] for w in words] if k % 2 else [w * 4 for w in words]
        elif kind == 5:
            words = words[:20] * 4 + words[20:40]
        text = "\n".join(" ".join(words[j : j + 5]) for j in range(0, len(words), 5))
        if kind == 6:
            text += "\n" + "\n".join(random.choice(text.split("\n")) for _ in range(random.randint(3, 12)))
        rows.append((100 + k, text, "en"))
    return rows


def random_name(seed):
    return "".join(random.Random(seed).choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(4 + seed % 5))


def test_quality_verdicts_equal_brute_force(spark):
    rows = quality_rows()
    want = [plain_kept(t) for _, t, _ in rows]
    assert 20 < sum(want) < len(rows) - 60
    found = {(r["doc_id"], r["kept"]) for r in Q.quality_report(documents(spark, rows)).collect()}
    assert found == {(i, k) for (i, _, _), k in zip(rows, want, strict=True)}
    kept = Q.quality_kept(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for (_, t, _), k in zip(rows, want, strict=True) if k)


def test_quality_verdict_does_not_depend_on_the_order(spark):
    docs = documents(spark, quality_rows())
    rules = [*Q.base_rules(), *Q.further_rules()]
    one, other = (docs.select("doc_id", Q.of_text(docs["text"], lambda q, r=r: Q.any_of(r, q)).alias("bad")) for r in (rules, rules[::-1]))
    assert one.exceptAll(other).count() == 0
    assert {r.name for r in Q.plan_cascade(docs, rules)} == {r.name for r in rules}


def test_cascade_orders_by_rejection_per_cost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dear = Q.Rule("dear", lambda q: F.length(F.regexp_replace(F.repeat(q("text"), 40), "(a|e|i)+x{9}", "")) < 0)
    cheap = Q.Rule("cheap", lambda q: q("n_words") < 0)
    dear_but_sharp = Q.Rule("sharp", lambda q: F.length(F.regexp_replace(q("text"), r"\P{L}+", "")) > 10)
    for rules in ([dear, cheap, dear_but_sharp], [dear, dear_but_sharp, cheap]):
        order = [r.name for r in Q.plan_cascade(docs, rules)]
        assert order[-1] == "dear" and set(order) == {"dear", "cheap", "sharp"}


def test_sample_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pick = lambda d: sorted(r["text"] for r in Q.sample_texts(d, rows=20).collect())
    first = pick(docs)
    assert len(first) == 20 and first == pick(docs.orderBy(F.length("text")).repartition(7))
    hot = docs.select("text").unionByName(docs.limit(1).select("text").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).select("text"))
    assert len(set(pick(hot))) == len(pick(hot))
    long = plain_documents(spark, [(k, "word " * 100_000, "en") for k in range(3)])
    assert len(pick(long)[0]) == 500_000


def test_a_filter_stays_above_the_statistics(spark):
    """The windows' hashes occur once, however the result is filtered."""
    report = Q.quality_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for rows in (report, report.where("kept"), report.where("NOT base_failed AND n_words > 60")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xxhash64(") == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found, want = queries.QUERIES[name](spark, small), con.sql(queries.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in found.collect()) == sorted(str([r[k] for k in order]) for r in want.fetchall())


# media


@pytest.mark.parametrize("height", [1, 2, 31, 32, 33, 200])
def test_png_round_trip(height):
    rng = np.random.default_rng(height)
    for samples in (rng.integers(0, 256, (height, 64), dtype=np.uint8), np.cumsum(np.ones((height, 64), np.uint8), axis=0, dtype=np.uint8), np.zeros((height, 64), np.uint8)):
        assert (M.decode_png(M.encode_png(samples)) == samples).all()
        assert len(M.cosine_hash(samples)) == 8


def test_all_filters_and_colours_are_read():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (10, 5, 3), dtype=np.uint8)
    flat = pixels.reshape(10, 15).astype(int)
    rows = b""
    for y in range(10):
        kind, line = y % 5, []
        for x in range(15):
            left = flat[y, x - 3] if x >= 3 else 0
            up = flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - 3] if x >= 3 and y else 0
            p = left + up - corner
            near = min((abs(p - v), k, v) for k, v in enumerate((left, up, corner)))[2]
            line.append((flat[y, x] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        rows += bytes([kind, *line])
    head = struct.pack(">IIBBBBB", 5, 10, 8, 2, 0, 0, 0)
    data = zlib.compress(rows)
    png = M.SIGNATURE + M._chunk(b"IHDR", head) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", data[:9]) + M._chunk(b"IDAT", data[9:]) + M._chunk(b"IEND", b"")
    assert (M.decode_png(png) == pixels).all()
    for bad in (png[:-20], png[:60] + b"x" + png[61:], b"no" + png):
        with pytest.raises(ValueError):
            M.decode_png(bad)


def test_media_rows(spark):
    found = M.media_report(documents(spark)).collect()
    assert len(found) == len(AWKWARD)
    by_text = {}
    for r in found:
        raw = (next(t for i, t, _ in AWKWARD if i == r["doc_id"]) or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        by_text.setdefault(raw, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values())
    assert M.media_report(documents(spark, [])).count() == 0


# sharding


def test_shards_hold_every_row(spark):
    docs = documents(spark).repartition(5)
    store, version = H.shard_table(docs)
    assert version == 2 and store.manifest(version).count() <= 2  # one file a tier: the long text's run is in a tier of its own
    back = store.read(version, docs)
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    third = store.append(version, docs.limit(2))
    assert store.read(third, docs).count() == len(AWKWARD) + 2 and store.read(version, docs).count() == len(AWKWARD)
    with pytest.raises(H.VersionExists):
        store._commit(third, store.manifest(version).drop("version"))
    store.vacuum(third)
    assert store.versions() == [third]
    assert store.read(third, docs).count() == len(AWKWARD) + 2


def test_of_two_writers_one_commits(spark, tmp_path):
    """Eight writers of one version at once, many times; the manifest is that of one of them, and no writer's rows mix with another's."""
    store = H.Store(spark, str(tmp_path / "s"))
    for k in range(1, 21):
        with ThreadPoolExecutor(8) as pool:
            done = list(pool.map(lambda n, k=k: attempt(store, f"versions/v{k:06d}", f"writer{n}"), range(8)))
        assert sum(done) == 1
        assert spark.read.text(f"{store.root}/versions/v{k:06d}").first()["value"] == f"writer{done.index(True)}"
    docs = plain_documents(spark)
    store = H.Store(spark, str(tmp_path / "t"))
    assert store.latest() is None and store.load(docs) == 1
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda n: attempt_append(store, docs, n), range(2)))
    assert done.count(None) == 1 and store.latest() == 2
    assert store.read(2, docs).count() == len(AWKWARD) + 1 + done.index(2)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda n: store.append_to_latest(docs.limit(1)), range(4))) == [3, 4, 5, 6]
    assert store.read(6, docs).count() == len(AWKWARD) + 5 + done.index(2)


def attempt(store, name, text):
    try:
        store._put(name, text)
        return True
    except H.VersionExists:
        return False


def attempt_append(store, docs, n):
    try:
        return store.append(1, docs.limit(n + 1))
    except H.VersionExists:
        return None


def test_readers_see_whole_versions_only(spark, tmp_path):
    """What a writer leaves before its last step is no version, and what it leaves for the reader is the whole manifest."""
    docs = plain_documents(spark)
    store = H.Store(spark, str(tmp_path / "s"))
    store.load(docs)
    docs.write.parquet(f"{store.root}/shards/waste/run=0")
    store.manifest(1).write.parquet(f"{store.root}/manifests/unfinished/_temporary/0")
    (tmp_path / "s" / "drafts").mkdir(exist_ok=True)
    (tmp_path / "s" / "drafts" / "x").write_text("unfinished")
    assert store.latest() == 1 and store.read(1, docs).count() == len(AWKWARD)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        store.manifest(2).count()


def test_merged_files_have_the_target_size(spark, tmp_path):
    """Runs of one tier with uneven shards."""
    store = H.Store(spark, str(tmp_path / "s"))
    noise = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.sha2(F.rand().cast("string"), 512).alias("text"))
    parts = [noise(n).coalesce(1) for n in (900, 2400, 200, 1500, 150, 2900, 700, 1100, 60, 2000)]
    folder = f"{store.root}/shards/a"
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/run={k}")
    target = store._shards(folder).agg(F.sum("bytes")).first()[0] // 4
    with store._scan_by_size(target):
        spark.read.parquet(f"{folder}/run=*").write.parquet(f"{folder}-merged")
    sizes = [r["bytes"] for r in store._shards(f"{folder}-merged").collect()]
    assert len(sizes) <= 6 and max(sizes) <= 1.2 * target and sorted(sizes)[1] > target / 3
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"
    assert spark.read.parquet(f"{folder}-merged").count() == 11910


def test_tiers_merge_runs_of_like_size_only(spark):
    docs = plain_documents(spark, [r for r in AWKWARD if len(r[1] or "") < 1000])
    store, version = H.shard_table(docs.repartition(2), target_bytes=1 << 20)
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    version = store.append(version, big)
    assert store.compact(version, 1 << 20) == version  # tiers of one run each
    version = store.append(store.append(version, docs), docs)
    before = store.manifest(version).select("run").distinct().count()
    (plan,) = store.plan(version, 1 << 20)
    assert len(plan["runs"]) >= 2
    after = store.compact(version, 1 << 20)
    assert store.manifest(after).select("run").distinct().count() == before - len(plan["runs"]) + 1
    assert store.read(after, docs).count() == 3 * docs.count() + 3000


def test_empty_table_and_clashing_run_column(spark):
    docs = documents(spark, []).withColumn("run", F.lit(1))
    store, version = H.shard_table(docs)
    assert store.read(version, docs).count() == 0
    full = documents(spark).withColumns({"run": F.lit(4), "version": F.lit(3)})
    store, version = H.shard_table(full)
    assert store.read(version, full).exceptAll(full).count() == 0


# WARC

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", h, 1, "x") for i, h in rows], "page_id long, url string, html string, payload_bytes int, digest string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    rows = [(5, "same"), (3, "same"), (9, "same"), (1, None), (2, ""), (4, FAKE + FAKE), (6, "x" * 300_000 + FAKE), (7, "é\r\n\r\nWARC/1.0\r\n"), (3, "same"), (None, "same"), (None, "alone"), (8, FAKE)]
    found = W.warc_round_trip(pages(spark, rows).repartition(3)).collect()
    want = []
    for i, h in rows:
        ids = [j for j, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids else None
        again = first is not None and i != first
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)
    assert W.warc_round_trip(pages(spark, [])).count() == 0


def archive(*payloads):
    out = b""
    for k, p in enumerate(payloads):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{digest(p)}\r\nContent-Length: {len(p.encode())}\r\n\r\n"
        out += (head + p).encode() + b"\r\n\r\n"
    return out


def walked(data):
    """The places of the records of an archive, one after another from its start; None if a record does not end where one may."""
    at, out = 0, []
    while at < len(data):
        head = data[at:].partition(b"\r\n\r\n")[0]
        m = re.search(rb"Content-Length: (\d+)", head)
        stop = at + len(head) + 4 + int(m[1]) if m and head.startswith(W.MAGIC) else len(data) + 1
        if data[stop : stop + 4] != b"\r\n\r\n":
            return None
        out.append(at)
        at = stop + 4
    return out


def in_ranges(spark, folder, files, width, split):
    """The records read in ranges of ``split`` bytes, by file."""
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    names = {f"spark.sql.files.{k}": v for k, v in (("maxPartitionBytes", str(split)), ("openCostInBytes", "0"))}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = {}
        for r in W.read_archives(spark, str(folder), width).collect():
            out.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["at"])
        return out
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("width, split", [(256, 1000), (64, 130), (1 << 20, 300), (512, 1 << 20)])
def test_chains_reach_true_records_only(spark, tmp_path, width, split):
    """Payloads full of records and of parts of their opening, in blocks and ranges of few bytes, against a walk from the start."""
    random.seed(width)
    files = {}
    for f in range(8):
        payloads = [random.choice(["a" * random.randint(0, 400), FAKE * random.randint(1, 4), archive("in", FAKE).decode(), "WARC/1.0\r\n" * 5, "WARC/1.WARC/1.0\r", "é\r\n\r\n" * 20, "y" * 2000 + FAKE]) for _ in range(random.randint(1, 15))]
        files[f"part-{f}"] = archive(*payloads)
    found = in_ranges(spark, tmp_path / "w", files, width, split)
    assert {n: sorted(v) for n, v in found.items()} == {n: walked(data) for n, data in files.items()}


def test_broken_archives_raise(spark, tmp_path):
    good = archive("abc", "def", "x" * 300 + FAKE + "y" * 300)
    assert len(in_ranges(spark, tmp_path / "good", {"part-0": good}, 64, 100)["part-0"]) == 3
    for k, bad in enumerate((good[:-10], good.replace(b"def", b"deX"), b"junk" + good, good.replace(b"y" * 300, b"y" * 299 + b"z"), good + b"WARC/1.0\r\n", good.replace(b"Length: 3\r", b"Length: 4\r", 1))):
        with pytest.raises(ValueError):
            in_ranges(spark, tmp_path / f"bad{k}", {"part-0": bad}, 64, 100)


def test_a_page_longer_than_a_range(spark):
    """Ten megabytes in ranges of one: its digest is gathered from all of them."""
    rows = [(1, "x" * 10_000_000), (2, FAKE * 40_000), (3, "short"), (4, "x" * 10_000_000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
        found = W.warc_round_trip(pages(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(i, len(h), digest(h), "revisit" if i == 4 else "response", 1 if i == 4 else None) for i, h in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_written_files_are_plain_archives(spark, tmp_path):
    folder = str(tmp_path / "w")
    W.write_archives(pages(spark, [(1, "a"), (2, "b")]).coalesce(1), folder)
    data = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect())
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:") and data.endswith(b"\r\n\r\n") and b"\r\nEvil" not in data
    assert len(walked(data)) == 2
