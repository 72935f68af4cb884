"""Names against the fixture rosters: scores, margins, exclusive assignment, held names, rounds."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import fuzzy as Z
from sheafwork.operators import leak as L
from sheafwork.operators import match as M

#: Names made of syllables, so that no two are alike.
ROSTER = [f"{a}{b} {c}{d}" for a, b, c, d in zip(
    ("Os", "Wil", "Tor", "Hed", "Ni", "Bru", "Fre", "Al", "Ju", "Sig", "Ma", "Ker"), ("kar", "ma", "sten", "vig", "las", "no", "da", "rik", "tta", "rid", "rten", "stin"),
    ("Bra", "Tesch", "Lind", "Oster", "Falk", "Wieg", "Grun", "Sand", "Holz", "Mohr", "Kling", "Ebert"), ("ndt", "ner", "qvist", "mann", "enau", "and", "wald", "vik", "apfel", "dieck", "spor", "sen"), strict=True)]


def garbled(rng, name):
    """A name as it might be read: as it is, with letters lost or changed, in the other order, or hardly at all."""
    kind = rng.randrange(6)
    if kind == 0:
        return name
    if kind == 1:
        return " ".join(reversed(name.upper().split()))
    if kind == 5:
        return rng.choice(["", "x 8", name[:2]])
    letters = list(name)
    for _ in range(kind):
        k = rng.randrange(len(letters))
        letters[k : k + 1] = rng.choice([[], [rng.choice("aeiou ")]])
    return "".join(letters)


def roster(spark, names):
    return spark.createDataFrame([(k, f"73104602{k:02}", n.split()[1], n.split()[0]) for k, n in enumerate(names, 1)], "ord int, sid string, last_name string, first_name string")


def probes(spark, names, rounds=None):
    return spark.createDataFrame([("f", f"t{k}", k, (rounds or {}).get(k), n) for k, n in enumerate(names)], "file_id string, tag string, ord int, round string, name_text string")


def test_assignments_equal_the_sequential_rule(spark):
    """Garbled names of a roster and of strangers: each entry goes, once a round, to the best probe that clears the bar."""
    rng = random.Random(43)
    names = [garbled(rng, rng.choice([*ROSTER, "Pelle Ungern", "Sig Mohr"])) for _ in range(60)]
    rounds = {k: rng.choice(["a", "b", None]) for k in range(60)}
    got = {r["ord"]: r["auto_sid"] for r in M.assign_exclusive(M.propose(probes(spark, names, rounds), roster(spark, ROSTER))).collect()}
    want, claims = dict.fromkeys(range(60)), []
    for k, name in enumerate(names):
        scores = sorted(((Z.py_score(name, *entry.split()), -n) for n, entry in enumerate(ROSTER)), reverse=True)
        if scores[0][0] >= M.LEAST_SCORE and scores[0][0] - scores[1][0] >= M.LEAST_MARGIN:
            claims.append((-scores[0][0], k, -scores[0][1]))
    taken = set()
    for _, k, n in sorted(claims):
        if (rounds[k] or "", n) not in taken:
            taken.add((rounds[k] or "", n))
            want[k] = f"73104602{n + 1:02}"
    assert got == want and 10 < len(taken) < len(claims)


def test_ratio_counts_the_common_letters():
    assert Z.py_ratio("oskar", "osar") == pytest.approx(200 * 4 / 9) and Z.py_ratio("", "") == 100
    assert Z.py_token_sort("brandt oskar", "oskar brandt") == 100


def test_held_name_wins_ties_and_packets_survive_an_empty_roster(spark):
    held = spark.createDataFrame([(1, "Brandt", "Oskar")], "ord int, last_name string, first_name string")
    one = probes(spark, ["Oskar Brandt", "", None])
    found = {r["ord"]: r for r in M.assign_exclusive(M.propose(one, roster(spark, ROSTER), held)).collect()}
    assert found[0]["is_held_match"] and found[0]["auto_sid"] is None and len(found) == 3
    empty = M.propose(one, roster(spark, ROSTER).where("false")).collect()
    assert len(empty) == 3 and all(r["top_sid"] is None and r["margin"] == 0 for r in empty)


def test_rounds_claim_separately(spark):
    found = M.assign_exclusive(M.propose(probes(spark, ["Oskar Brandt"] * 3, {0: "a", 1: "b", 2: "b"}), roster(spark, ROSTER)))
    assert [r["auto_sid"] is not None for r in found.orderBy("ord").collect()] == [True, True, False]


def test_native_scorers_equal_python(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcde é") for _ in range(random.choice([0, 1, 5, 20, 70])))
    rows = [(word(), word()) for _ in range(120)]
    frame = spark.createDataFrame(rows, "a string, b string").select("a", "b", Z.ratio("a", "b").alias("r"), Z.token_sort_ratio("a", "b").alias("t"))
    for r in frame.collect():
        assert abs(r["r"] - Z.py_ratio(r["a"], r["b"])) < 1e-9
        assert abs(r["t"] - Z.py_token_sort(r["a"], r["b"])) < 1e-9


def test_grids_equal_the_rules_to_the_last_bit():
    """Shared, repeated, missing and long words, lengths far apart."""
    from sheafwork.functions import grids

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 5, 8, 40])))
    text = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 2, 3])))
    for _ in range(10):
        names = [*((text(), text()) for _ in range(9)), ("", word()), ("", ""), ("ab", "ab")]
        forms = [[*{Z.py_normalize(x) for x in (f"{a} {b}", f"{b} {a}", a, b)} - {""}] for a, b in names]
        plain, weighted = grids.plain_grid(forms), grids.weighted_grid(forms)
        for probe in [text(), text(), names[0][0], " ".join(names[1]), "ab"]:
            assert weighted(probe).tolist() == [Z.py_score(probe, *n) for n in names]
            assert plain(probe).tolist() == [max([max(Z.py_ratio(probe, v), Z.py_token_sort(probe, v)) for v in f], default=0) for f in forms]


def test_best_names_of_a_grid_equal_all_its_scores_but_compare_few_pairs(monkeypatch):
    """Equal, empty, long and repeated names; odd texts; ties go to the earlier name. Of like names most cannot be among the best."""
    from sheafwork.functions import grids

    rng = random.Random(17)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 4, 5, 8])))
    forms_of = lambda names: [[x for x in dict.fromkeys(map(Z.py_normalize, (f"{a} {b}", f"{b} {a}", b, a))) if x] for a, b in names]
    for n in (1, 4, 30):
        names = [(word("abcé"), word("abcdefg")) for _ in range(n)] + [("", word("abc")), ("", ""), ("ab", "ab"), ("", ""), ("x" * 70, "b")]
        names += names[:3]
        texts = [*dict.fromkeys([*(f"{word('abc')} {word('abcdé')}" for _ in range(6)), *(" ".join(x).strip() for x in names[:3]), word("abc"), "ab", "", "zz yy", "ab ab", "q" * 65, " ab\tcd"])]
        for grid in (grids.plain_grid(forms_of(names)), grids.weighted_grid(forms_of(names))):
            for k in (1, 2, 5, len(names) + 2):
                got = {t: [] for t in range(len(texts))}
                for t, row, score in zip(*grid.best(texts, k), strict=True):
                    got[t].append((row, score))
                for t, text in enumerate(texts):
                    scores = grid(text)
                    assert got[t] == sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))[:k]

    pairs, ratios = [], grids._pair_ratios
    monkeypatch.setattr(grids, "_pair_ratios", lambda *a: pairs.append(len(a[-1])) or ratios(*a))
    names = [("".join(rng.choice("aeioubcdfg") for _ in range(5)), "".join(rng.choice("rstlnmaeio") for _ in range(6))) for _ in range(1500)]
    texts = [f"{a[:2]}{a[3:]} {b}" for a, b in names[:100]]
    for make in (grids.plain_grid, grids.weighted_grid):
        pairs.clear()
        of, rows, _ = make(forms_of(names)).best(texts, 2)
        assert rows[::2].tolist() == list(range(100)) and of.tolist() == [t for t in range(100) for _ in range(2)]
        assert sum(pairs) < 0.2 * 2 * 4 * len(texts) * len(names)


def test_weighted_best_names_slide_few_windows(monkeypatch):
    """Names of one word against texts of two: most share too few letters for a window to be among the best two."""
    from sheafwork.functions import grids

    rng, slid, windows = random.Random(23), [], grids._pair_windows
    monkeypatch.setattr(grids, "_pair_windows", lambda *a: slid.append(len(a[-1])) or windows(*a))
    words = [*dict.fromkeys("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(400))]
    texts = [f"{w[:5]}z {rng.choice('pqrst')}yxw" for w in words[:30]]
    grid = grids.weighted_grid([[w] for w in words])
    _, rows, scores = grid.best(texts, 2)
    for t, text in enumerate(texts):
        want = sorted(enumerate(Z.py_score(text, w, "") for w in words), key=lambda x: (-x[1], x[0]))[:2]
        assert [*zip(rows[2 * t : 2 * t + 2].tolist(), scores[2 * t : 2 * t + 2].tolist(), strict=True)] == want
    assert 0 < sum(slid) < 0.3 * 2 * len(words) * len(texts)


def test_few_windows_are_slid_and_shared_words_follow_the_rule(monkeypatch):
    """Of the pairs whose letters allow a window most have none that can hold enough; pairs that share a word equal the rule without its short ways."""
    from sheafwork.functions import grids

    rng, slid, windows, over = random.Random(29), [], [], grids._rows_over_text
    monkeypatch.setattr(grids, "_rows_over_text", lambda met, size: slid.append(met.shape[1]) or over(met, size))
    all_pairs = grids._pair_windows
    monkeypatch.setattr(grids, "_pair_windows", lambda *a: windows.append(len(a[3])) or all_pairs(*a))
    names = [("".join(rng.choice("aeioubcdfg") for _ in range(4)), "".join(rng.choice("rstlnmaeio") for _ in range(5))) for _ in range(300)]
    texts = [*dict.fromkeys(f"{a[:2]} {a[3:]} {b}" for a, b in names[:30])]
    _, rows, scores = grids.weighted_grid([[f"{a} {b}", f"{b} {a}", b, a] for a, b in names]).best(texts, 2)
    for t, text in enumerate(texts):
        want = sorted(enumerate(Z.py_score(text, *n) for n in names), key=lambda x: (-x[1], x[0]))[:2]
        assert [*zip(rows[2 * t : 2 * t + 2].tolist(), scores[2 * t : 2 * t + 2].tolist(), strict=True)] == want
    assert 0 < sum(slid) < 0.5 * sum(windows)

    def slide(a, b):
        if len(a) == len(b):
            return max(Z._windows(a, b), Z._windows(b, a))
        return Z._windows(*sorted((a, b), key=len))

    for _ in range(3000):
        a, b = (" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 9, 11, 14]))) for _ in range(rng.choice([1, 2, 3]))) for _ in range(2))
        unlike, plain = max(len(a), len(b)) / min(len(a), len(b)), Z.py_ratio(a, b)
        scale = 0.9 if unlike <= 8 else 0.6
        by_words = 100.0 if set(a.split()) & set(b.split()) else max(slide(*(" ".join(sorted(x)) for x in pair)) for pair in ((a.split(), b.split()), (set(a.split()), set(b.split()))))
        rule = max(plain, 0.95 * max(Z.py_token_sort(a, b), Z.py_token_set(a, b))) if unlike < 1.5 else max(plain, scale * slide(a, b), 0.95 * scale * by_words)
        assert Z.py_weighted(a, b) == rule
        known = max(plain, Z.py_token_sort(a, b))
        assert max(known, Z.py_weighted(a, b, known)) == max(known, rule)


def test_assignment_scores_names_once(spark):
    """Claims are a window over the proposals: names are scored once against the roster and once against the held names."""
    held = spark.createDataFrame([(1, "Brandt", "Oskar")], "ord int, last_name string, first_name string")
    rows = M.assign_exclusive(M.propose(probes(spark, ["Wilma Teschner", " WILMA  teschner", "Oskar Brandt", None]), roster(spark, ROSTER), held))
    assert [r["auto_sid"] is not None for r in rows.orderBy("ord").collect()] == [True, False, False, False]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


@pytest.mark.parametrize("scorer", [Z.native_name_score, Z.name_score])
@pytest.mark.parametrize("by", [None, ["file_id"]])
def test_best_candidates_equal_all_pairs_in_small_blocks(spark, monkeypatch, scorer, by):
    """Texts and entries over several blocks, equal names and texts, more classes than one; a repeated packet text is not paired again."""
    monkeypatch.setattr(M, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(M, "BLOCK_ENTRIES", 5)
    rng = random.Random(3)
    names = [garbled(rng, rng.choice(ROSTER)) for _ in range(40)] * 2
    entries = roster(spark, [*ROSTER, *ROSTER[:4], "Oska Brand"]).withColumn("file_id", F.when(F.col("ord") % 3 > 0, "f").otherwise("g"))
    entries = entries if by else entries.drop("file_id")
    packets = probes(spark, names).withColumn("file_id", F.when(F.col("ord") % 2 == 0, "f").otherwise("g"))
    rows = lambda frame: sorted((r["tag"], r["rank"], r["sid"], r["score"]) for r in frame.collect())
    found = M.best_candidates(packets, entries, scorer, by)
    assert rows(found) == rows(M.top_candidates(M.score_pairs(packets, entries, scorer, by)))
    assert rows(M.best_candidates(packets, entries, lambda *a: scorer(*a), by)) == rows(found)


def test_duplicate_decisions(spark):
    decisions = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "tag string, sid string")
    labels = spark.createDataFrame([("a", "x"), ("b", "x")], "tag string, label string")
    assert [(r["label"], r["sid"], r["tags"]) for r in M.duplicate_decisions(decisions, labels).collect()] == [("x", "1", ["a", "b"])]


def test_plan_broadcasts_a_small_roster(spark):
    pairs = M.score_pairs(probes(spark, ["Oskar Brandt"]), roster(spark, ROSTER), Z.native_name_score)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
    assert pairs.agg(F.count("*")).first()[0] == len(ROSTER)


def test_leak_findings_of_documents_equal_brute_force(spark, small):
    """All words of the benchmark against some documents, pair by pair."""
    from sheafwork.queries import QUERIES

    def tokens(text):
        return {x.lower() for x in re.findall("[A-Za-z']+", text or "")}

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return 200 * row[-1] / (len(a) + len(b))

    docs = {f"d{r['doc_id']}": tokens(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(4).collect()}
    items = {f"{r['item_id']:010}": {x for x in tokens(r["text"]) if len(x) >= 3} for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    like = {}
    for a in {x for own in docs.values() for x in own if len(x) >= 5}:
        for b in {x for own in items.values() for x in own if len(x) >= 5}:
            if 2 * sum((Counter(a) & Counter(b)).values()) >= 0.8 * (len(a) + len(b)) and ratio(a, b) >= 80:
                like.setdefault(a, []).append(b)
    want = []
    for d, own in docs.items():
        for sid, names in items.items():
            want += [(d, sid, x, True) for x in own & names]
            want += [(d, sid, x, False) for x in own - names for b in like.get(x, ()) if b in names]
    found = [(r["file_id"], r["sid"], r["token"], r["exact"]) for r in QUERIES["leak_findings_documents"](spark, small).where(F.col("file_id").isin(list(docs))).collect()]
    assert sorted(found) == sorted(want) and len({x[3] for x in want}) == 2
    report = {r["file_id"]: (r["n_findings"], r["n_exact"]) for r in QUERIES["leak_report_documents"](spark, small).where(F.col("file_id").isin(list(docs))).collect()}
    assert report == {d: (sum(x[0] == d for x in want), sum(x[0] == d and x[3] for x in want)) for d in docs}


def test_fuzzy_pairs_equal_brute_force(spark):
    """Words of few letters, so that many are alike: edited copies, long repeats, lengths on both sides of where the keys change."""
    rng = random.Random(5)
    tokens, names = set(), {"a" * 36, "a" * 34 + "b" * 9}
    for k in range(600):
        word = "".join(rng.choice("abcdee'z") for _ in range(rng.choice([5, 6, 7, 8, 9, 12, 20, 24, 26, 31])))
        other = list(word)
        for _ in range(rng.randrange(4)):
            other[rng.randrange(len(other))] = rng.choice("abcdexyz")
        tokens.add(word)
        names.add("".join(other[1:] if k % 2 and len(other) > 6 else other))
    tokens |= {"a" * 40, "a" * 33 + "b" * 8}
    want = sorted((x, y) for x in tokens for y in names if Z.py_ratio(x, y) >= L.LEAST_RATIO)
    as_table = lambda words, name: spark.createDataFrame([(w,) for w in sorted(words)], f"{name} string")
    assert sorted(map(tuple, L.fuzzy_pairs(as_table(tokens, "token"), as_table(names, "name")).collect())) == want and len(want) > 300
