import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, decontaminate, html, katz, lines, minhash, pii, quality, urls

random.seed(3)
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def words(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [words(80) for _ in range(12)]
    texts = [*base, base[0], base[1].replace(" ", "  ", 1), base[2] + " extra", base[3] + "\n" + base[4], None, "", "one", "x " * 3000, base[5].upper()]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[6], "en", "s", 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_urls(spark):
    rows = [(1, "HTTP://Www.Spam.example.ORG:80/a/?utm_source=x&b=2&a=1#f"), (2, "https://spam.example.org/a?a=1&b=2"), (3, "http://other.org/a"), (4, None), (5, "no scheme"), (6, "http://a.example.com/en/x"), (7, "http://b.www.example.com/en/x"), (8, "ftp://x.net/fr/"), (9, "http://x.com")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, rule string")
    listed = pages.where("page_id = 2").select(urls.canonical_url(F.col("url")).alias("canonical"))
    out = {r["page_id"]: r for r in urls.judge(pages, listed, urls.CONTRACT_RULES).collect()}
    assert [out[i]["verdict"] for i in range(1, 10)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow"]
    assert (out[1]["host"], out[1]["path"], out[4]["host"], out[9]["rule"]) == ("www.spam.example.org:80", "/a/", "", None)
    assert urls.judge(pages.limit(0), listed).count() == 0 and urls.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_pii(spark):
    text = "é a@b.com_x@y.co 1.2.3.4.5.6.7.8 999.1.1.1 card 4111-1111 1111 1111; +1 (555) 123-4567, IBAN GB82 WEST 1234 5698 7654 32 phone 555-123-4567 " + "a" * 5000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1" * 20 + " 5." * 300)], "doc_id long, text string")
    out = {r["doc_id"]: r["pii"] for r in pii.find_pii(df).collect()}
    got = [(s["kind"], text[s["start"] : s["end"]]) for s in out[1]]
    assert got == [("email", "a@b.com"), ("email", "_x@y.co"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111-1111 1111 1111"), ("phone", "+1 (555) 123-4567"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("localphone", "555-123-4567")]
    assert out[2] == [] and out[3] == [] and out[4] == []
    many = spark.createDataFrame([(1, " ".join(f"u{i}@h.org" for i in range(700)))], "doc_id long, text string")
    spans = pii.find_pii(many).first()["pii"]
    assert len(spans) == 700 and len({s["start"] for s in spans}) == 700


def test_pii_context_across_other_matches(spark):
    """One context word before several numbers, or behind them; context is BEFORE and AFTER characters of the text."""
    texts = ["Visa card (exp 12/25): 4222222222222", "Call 555-123-4567 or 555-123-9999", "555-123-4567, 555-12 fax", "é" * 9 + "phone" + " 10" * 11 + " 555-123-4567", "phone" + " 10" * 12 + " 555-123-4567", "555-123-4567 or 555-123-9999 fax", "555-123-4567 and 555-123-9999 fax"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["pii"]] for r in pii.find_pii(df).collect()}
    number = "555-123-4567"
    assert got == {0: ["4222222222222"], 1: [number, "555-123-9999"], 2: [number], 3: [number], 4: [], 5: [number, "555-123-9999"], 6: ["555-123-9999"]}


def _brute_pii(text):
    """(base spans, all spans) by Python's re and plain loops."""
    import re
    from collections import Counter
    from math import log2

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((m.start(), 5 if len(digits(m[0])) == 13 else 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        v = m[0].replace(" ", "")
        if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
            found.append((m.start(), 4, m.end()))
    for m in re.finditer(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", text):
        found.append((m.start(), 6, m.end()))
    for m in re.finditer(r"[A-Za-z0-9_-]+", text):
        v, n = m[0], len(m[0])
        if n >= 20 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and -sum(c / n * log2(c / n) for c in Counter(v).values()) >= pii.MIN_ENTROPY:
            found.append((m.start(), 7, m.end()))
    base = sorted(x for x in found if x[1] < 4)
    more = []
    for a, rank, b in found:
        kind = pii.KINDS[rank]
        near = text[max(0, a - 40) : a] + " " + text[b : b + 20]
        score = pii.SCORES[kind] + (0.3 if re.search(pii.CONTEXT[kind], near, re.I) else 0)
        if rank >= 4 and score >= pii.THRESHOLD and not any(x < b and a < y for x, _, y in base):
            more.append((a, rank, b))
    return base, sorted(base + more)


def test_pii_against_brute_force(spark):
    bits = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4222222222222", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "(555) 123-4567", "555.123.4567"]
    bits += ["token = ", "api_key: ", "Visa card", "IBAN", "call", "é🙂", "\n", "password", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "aaaaaaaaaaaaaaaaaaaaaaaa1", "a-very-long-hyphenated-word-of-no-digits", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "word", "12", "-", "."]
    texts = ["".join(random.choice(bits) + random.choice([" ", " ", "", "; "]) for _ in range(random.randrange(25))) for _ in range(300)]
    texts += [None, "", "key " + "x1y2z3w4v5u6t7s8r9q0p" * 11, words(20000) + " token 04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(3, texts[3], "a", "b")], "doc_id long, text string, _all string, pii string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(texts) + 1 and pii.find_pii(df.limit(0)).count() == 0
    kinds = set()
    for r in rows:
        base, every = _brute_pii(texts[r["doc_id"]] or "")
        got = [(s["start"], s["rank"], s["end"]) for s in r["pii"]]
        assert got == every and [g for g in got if g[1] < 4] == base and r["_all"] == "a"
        kinds |= {g[1] for g in got}
    assert kinds == set(range(8))


def test_quality_rules(docs):
    assert quality.text_rules("a b\n\na b\n c|#é\n") == (5, 8, 2, 1, 0)
    w = [f"w{i}" for i in range(8)]
    assert quality.text_rules(" ".join(w + ["z"] + w))[4] == 16
    assert quality.text_rules(" ".join(["q"] * 10))[4] == 10
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    out = {r["doc_id"]: r for r in rows}
    assert out[16]["base_failed"] and out[17]["base_failed"] and out[19]["base_failed"] and out[1]["kept"]
    assert quality.quality(docs.limit(0)).count() == 0


def test_kneser_ney_sums_to_one(spark, docs):
    """Every context of every order, over the symbols seen and the unseen ones, which share one backoff."""
    import numpy as np

    model = quality.Arrays(quality.kneser_ney(quality.count_grams(docs)).toPandas())
    seen = model.levels[2][0]
    for k in range(1, 5):
        for ctx in model.levels[2 * k - 1][0][:: 1 if k < 3 else 40]:
            key = (ctx << np.uint64(16)) | seen
            unseen = (ctx << np.uint64(16)) | np.uint64(0x2603)
            assert (2 ** model.log2(key, k)).sum() + (2**16 - len(seen)) * 2 ** model.log2(np.array([unseen]), k)[0] == pytest.approx(1)


def test_joined_model_equals_broadcast(spark, docs, monkeypatch):
    """Blocks that ask the model by joins give the same rows; clashing and null columns pass."""
    monkeypatch.setattr(quality, "_BLOCK", 2000)
    odd = docs.withColumn("text", F.concat("text", F.lit(" é漢🙂")))
    rows = [sorted(quality.quality(odd, max_entries=m).collect(), key=str) for m in (quality.MAX_ENTRIES, 0)]
    assert len(rows[0]) == odd.count() and [{**r.asDict(), "log2_ppl": 0} for r in rows[0]] == [{**r.asDict(), "log2_ppl": 0} for r in rows[1]]
    assert [r["log2_ppl"] for r in rows[0]] == pytest.approx([r["log2_ppl"] for r in rows[1]])
    assert quality.quality(docs.limit(0), max_entries=-1).count() == 0


def test_quality_bands_reject_junk(spark):
    """Shouting, symbols and tables are no reference and fall out of their language's band; prose of both languages stays, as do languages of few documents."""
    other = str.maketrans("aeioubdfgk", "éàùöñвдфгк")
    prose = [(f"p{i}", words(60) if i % 2 else words(60).translate(other), "en" if i % 2 else "xx") for i in range(240)]
    junk = [(f"j{i}", f(words(60)), "en") for i, f in enumerate((lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | "), lambda t: t[::-1].swapcase()))]
    df = spark.createDataFrame([*prose, *junk, ("few", words(40), "yy"), ("none", words(40), None)], "doc_id string, text string, lang string")
    out = by_id(quality.quality(df))
    assert [i for i in out if not out[i]["kept"]] and not any(out[i]["kept"] for i, *_ in junk)
    assert all(out[i]["kept"] for i, *_ in prose) and out["few"]["kept"] and out["none"]["kept"]


def test_quality_metrics_against_brute_force(spark):
    import re
    from collections import Counter

    pool = ["a", "b", "#x", "É", "\u00a0", "a|b"]
    texts = ["".join(random.choice(pool) + random.choice([" ", " ", "\n", "\t", "\x0b", "\r"]) for _ in range(random.randrange(90))) for _ in range(150)]
    out = by_id(quality.quality(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {j + k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(8)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(again))
        assert tuple(out[i][c] for c in quality.METRICS) == want
        assert out[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_line_dedup(spark):
    pool = [words(n) for n in (3, 8, 20, 30, 55, 60, 12, 12)]
    texts = ["\n".join(random.choice(pool) if random.random() < 0.8 else words(9) for _ in range(random.randrange(0, 9))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5), (99, None, 5)], "doc_id long, text string, n_chars int")
    first, lost = {}, set()
    for d, t in enumerate(texts):
        ls = [(i, x) for i, x in enumerate(t.split("\n")) if x.split()]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(x.split()) for _, x in ls[a:b]) >= 50 and first.setdefault(tuple(x for _, x in ls[a:b]), (d, a)) != (d, a):
                    lost |= {(d, i) for i, _ in ls[a:b]}
    assert {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(df).collect()} == lost
    out = by_id(lines.remove_repeats(df, drop_empty=False))
    assert all(out[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in lost) for d, t in enumerate(texts))
    assert out[99]["text"] is None and lines.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot_share", [1, 12, 1000])
def test_common_prefixes_with_earlier_suffixes(spark, monkeypatch, hot_share):
    """Every suffix's longest prefix that an earlier suffix shares, and the first copy of it, by brute force; long repeats take many rounds. No key, some and all are hot."""
    monkeypatch.setattr(lines, "HOT_SHARE", hot_share)
    pool = [f"l{i} " + "w " * (i % 4) for i in range(5)]
    block = [random.choice(pool) for _ in range(70)]
    texts = ["\n".join(x) for x in (block, block[10:], ["once"] + block[3:40] + ["twice"] + block[20:], pool * 9, [pool[0]] * 40, [])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    segments = lines.line_sequences(df, 6)
    seqs = {r["seg"]: [(x["id"], x["words"]) for x in r["l"]] for r in segments.collect()}
    suffixes = sorted((s, p) for s, l in seqs.items() for p in range(len(l)))
    want = set()
    for s, p in suffixes:
        mine, best = seqs[s][p:], (0, None)
        for t, q in suffixes:
            if (t, q) >= (s, p):
                break
            n = next((i for i, (x, y) in enumerate(zip(mine, seqs[t][q:])) if x != y), min(len(mine), len(seqs[t]) - q))
            best = max(best, (n, (-t, -q)), key=lambda b: b[0])
        if sum(w for _, w in mine[: best[0]]) >= 6:
            want.add((s, p, best[0], -best[1][0], -best[1][1]))
    got = {(r["seg"], r["p"], r["len"], *r["first"]) for r in lines.repeated_runs(segments, 6).collect()}
    assert got == want and max(w[2] for w in want) >= 37
    ranks = lines.suffix_ranks(segments.select("seg", F.posexplode("l.id").alias("p", "rank")))
    for k, rank in enumerate(ranks):
        rows = sorted((r["rank"], [x for x, _ in seqs[r["seg"]][r["p"] : r["p"] + 2**k]]) for r in rank.collect())
        assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_line_dedup_keeps_clashing_columns(spark):
    text, big = words(60), "\n".join(words(5) for _ in range(4000))
    rows = [(1, text, 7, "a", 1), (2, text + "\n" + words(3), 7, "b", 2), (None, text, 7, "c", 3), (4, big, 7, "d", 4), (5, big, 7, "e", 5), (5, big, 7, "e", 5), (6, "", 7, "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _maybe string, _gone long")
    out = sorted(map(tuple, lines.remove_repeats(df).collect()), key=str)
    tail = rows[1][1].split("\n")[1]
    assert out == sorted([(2, tail, len(tail), "b", 2), rows[2], rows[3], rows[6]], key=str)
    assert lines.remove_repeats(df).columns == df.columns


def test_near_duplicates(spark, docs):
    out = docs.select("doc_id", "text").collect()
    sets = {}
    for r in out:
        if r["doc_id"] is not None:
            w = (r["text"] or "").lower().split()
            sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = minhash.near_duplicates(docs, width=2).collect()
    assert len(rows) == len(out)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (find(r["doc_id"]), len(sets[r["doc_id"]]))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """More members than a small bucket holds: blocks are compared, and components stay exact."""
    base = words(120).split()
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 14):
            w[random.randrange(120)] = f"new{random.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    root = list(range(90))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2).collect()} == {i: find(i) for i in range(90)}


def test_decontamination(spark):
    items = [words(30), words(16), words(9), words(4)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string")
    w = items[0].split()
    for i in (4, 11, 17):
        w[i] = "changed"
    texts = [words(50) + " " + items[0].upper() + ", " + words(5), words(9) + " " + " ".join(w), items[1], items[2] + " " + words(60), words(300), None, "", items[3] + " " + words(30)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, matched string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()} == {(0, 0), (1, 0), (2, 1), (3, 2), (7, 3)}
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(df, bench).collect()) == [4, 5, 6]
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0


def test_decontamination_against_brute_force(spark):
    """Every pair with its best window (the first on ties); repeated rows, one very long text, short items."""
    from math import ceil

    small = VOCAB[:40]
    some = lambda n: [random.choice(small) for _ in range(n)]
    items = [some(random.choice([1, 3, 5, 7, 8, 12, 15, 20, 40])) for _ in range(25)]
    texts = []
    for i in range(60):
        w = some(random.randrange(70))
        for x in random.sample(items, 2):
            x = [random.choice(small) if random.random() < 0.15 else y for y in x]
            at = random.randrange(len(w) + 1)
            w[at:at] = x[: random.randrange(1, len(x) + 1)] if i % 3 else x
        texts.append(w)
    texts.append(some(30000) + items[8] + some(5))
    want = {}
    for d, a in enumerate(texts):
        for j, b in enumerate(items):
            least, best = (min(12, ceil(0.8 * len(b))) if len(b) >= 8 else len(b)), None
            if d == 60 and j != 8:  # the long text: by the item that it was given
                continue
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [a[i + shift] == b[i] for i in range(lo, hi)]
                n = min(17, hi - lo)
                for i in range(hi - lo - n + 1):
                    m = sum(same[i : i + n])
                    if m >= least:
                        best = max(best or (0,), (m, -(lo + shift + i), -(lo + i)))
            if best:
                want[d, j] = (best[0], -best[1], -best[2])
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)] + [(0, " ".join(texts[0]))], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w), "c") for j, w in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["doc_token"], r["item_token"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert {k: v for k, v in got.items() if k[0] < 60 or k[1] == 8} == want and any(len(items[j]) < 8 for _, j in want)


def test_decontamination_masks_hit_every_overlap(spark):
    """All places of substitutions that an overlap allows, by enumeration; and a short item with one of them."""
    from itertools import combinations
    from math import ceil

    for n in range(decontaminate.MIN_ITEM, decontaminate.WINDOW + 1):
        looks = [{i + j for j, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for i in range(n - len(m) + 1)]
        lost = n - min(decontaminate.MATCHES, ceil(0.8 * n))
        assert all(any(look.isdisjoint(out) for look in looks) for out in combinations(range(n), lost))
    item = words(8)
    texts = [words(20) + " " + " ".join("changed" if i == k else w for i, w in enumerate(item.split())) + " " + words(20) for k in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.overlaps(df, bench).collect()) == list(range(8))


def test_katz(docs):
    import math
    from collections import Counter

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seqs = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    uni, bi = Counter(), Counter()
    for s in seqs:
        uni.update(s)
        bi.update(zip([None, *s[:-1]], s))
    model = katz.Katz(docs)
    d = katz.discounts(Counter(bi.values()))
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.types) == (n, v)
    p = lambda x: (uni[x] + 1) / (n + v + 1)
    ctx = {}
    for (a, b), k in bi.items():
        c = ctx.setdefault(a, [0, 0.0, 0.0])
        c[0] += k
        c[1] += k * (d[k - 1] if k <= katz.CUTOFF else 1)
        c[2] += p(b)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 6), round(r["base_score"], 6)) for r in model.score().collect())
    want = []
    for (i, _), s in zip(rows, seqs, strict=True):
        total = 0.0
        for a, b in zip([None, *s[:-1]], s):
            c, m, _ = ctx[a]
            k = bi[a, b]
            total += math.log10(k * (d[k - 1] if k <= katz.CUTOFF else 1) * (1 - max(1 - m / c, 1 / (c + 1))) / m)
        want.append((i if i is not None else -1, round(total, 6), round(sum(math.log10(p(x)) for x in s), 6)))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [x for g in got for x in g[1:]] == pytest.approx([x for w in sorted(want) for x in w[1:]], abs=1e-4)


@pytest.mark.parametrize("block, shard, split", [(3_000_000, 2_000_000, 4), (500, 700, 40)])
def test_katz_held_out(docs, monkeypatch, block, shard, split):
    """Unseen words and pairs back off; contexts sum to one; small blocks and split contexts change nothing."""
    import math
    from collections import Counter

    for name, v in (("BLOCK", block), ("SHARD", shard), ("SPLIT", split)):
        monkeypatch.setattr(katz, name, v)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {None: False} | {r["doc_id"]: r["h"] for r in docs.select("doc_id", katz.held_out(F.col("doc_id")).alias("h")).collect()}
    seqs = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    uni, bi = Counter(), Counter()
    for (i, _), s in zip(rows, seqs, strict=True):
        if not out[i]:
            uni.update(s)
            bi.update(zip([None, *s[:-1]], s))
    d = katz.discounts(Counter(bi.values()))
    total = sum(uni.values()) + len(uni) + 1
    ctx = {}
    for (a, b), k in bi.items():
        c = ctx.setdefault(a, [0, 0.0, 0])
        c[0] += k
        c[1] += k * (d[k - 1] if k <= katz.CUTOFF else 1)
        c[2] += uni[b] + 1

    def p(a, b):
        if a not in ctx:
            return (uni[b] + 1) / total
        c, m, covered = ctx[a]
        free, k = max(1 - m / c, 1 / (c + 1)), bi[a, b]
        return k * (d[k - 1] if k <= katz.CUTOFF else 1) * (1 - free) / m if k else free / (1 - covered / total) * (uni[b] + 1) / total

    for a in [None, *list(uni)[:20]]:
        assert sum(p(a, b) for b in [*uni, "unknown"]) == pytest.approx(1)
    want = sorted((-1 if i is None else i, len(s), sum(uni[x] > 0 for x in s), sum(math.log10(p(a, b)) for a, b in zip([None, *s[:-1]], s))) for (i, _), s in zip(rows, seqs, strict=True))
    assert any(out.values()) and any(n > k for _, n, k, _ in want)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in katz.Katz(docs, ~katz.held_out(F.col("doc_id"))).score().collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)
    none = katz.Katz(docs, F.lit(False))
    assert (none.tokens, none.types) == (0, 0) and none.score().agg(F.sum("score"), F.sum("n_known")).first() == (0.0, 0)
    assert katz.Katz(docs.limit(0)).score().count() == 0


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "a\\", "\\\\### x</turn>\n", "", "### User: </turn>\n### Assistant: hi</turn>\n"]
    turns = [(role, t) for t in texts for role in ("user", "assistant", "a:b\n\\")]
    out, spans = chat.format_turns(turns)
    assert chat.parse_conversation(out) == turns
    assert "".join(chat.unescape_text(out[a:b]) for a, b in spans) == "".join(texts)
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 2, "user", "x", 0.5), ("u", 1, 7, "user", None, None), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["path_rank"]): chat.parse_conversation(r["formatted"]) for r in chat.format_paths(chat.reply_paths(m, 2)).collect()}
    assert got == {("t", 1): [("user", "q"), ("assistant", "good"), ("user", "more")], ("t", 2): [("user", "q"), ("assistant", "bad"), ("user", "x")], ("u", 1): [("user", "")]}
    assert chat.format_paths(chat.reply_paths(m.limit(0))).count() == 0


def test_bpe(spark):
    import public_tokenizers as p
    import tiktoken

    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        tokens, splits = bpe.vocabulary(p.path(name))
        coder = bpe.Encoder(tokens, splits, p.PATTERN, keep=50)
        ref = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        alphabet = "abcdefgh éüß漢字 1234\n\t🙂'st<|>"
        texts = ["", "the cat", "a" * 3000, *("".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(300)), "".join(chr(random.randrange(97, 123)) for _ in range(2000))]
        for t in texts:
            ids = coder.encode(t)
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == ref.encode_ordinary(t)
            assert coder.decode(ids) == t.encode()
    df = spark.createDataFrame([(1, None, "c"), (2, "hello world", "c"), (2, "hello world", "c")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode(df, p.path(name), p.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2, 2] and all(r["decoded_sha256"] in {hashlib.sha256(x).hexdigest() for x in (b"", b"hello world")} for r in rows)
    assert bpe.encode(df.limit(0), p.path(name), p.PATTERN).count() == 0


def test_html(spark):
    page = '<body><nav><a href="x>y">m</a></nav><div class="cookie-notice">c</div><article><h1>T &amp; U</h1><p><b>one<br>two<p>three <script>if(a<b)"</p>"</script>&eacute;</p><ul><li>x<li>y</ul><div id=comments><p>no</p></div></article><footer>f</footer>'
    bare = "<div><p>Header of the site</p></div><div><p>own {}</p><p>Text</p></div><div>legal</div>"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "http://a/2", ""), (4, "http://a/3", "plain &lt; text"), *((10 + i, "http://b/" + str(i), bare.format(i)) for i in range(6))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    out = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert out[1] == "T & U\none two\nthree é\nx\ny" and out[2] == "" and out[3] == "" and out[4] == "plain < text"
    assert out[10] == "own 0"
    assert html.extract(df.limit(0)).count() == 0


def test_html_copies_and_chance_repeats(spark):
    """Five copies of a page without article, one url or five; a paragraph that a few pages of a large host share."""
    copy = "<div><p>Whole text</p></div><p>More</p>"
    rows = [*(("http://c/1", copy),) * 5, *((f"http://d/{i}", copy + f"<nav>{i}</nav>") for i in range(5))]
    rows += [(f"http://e/{i}", f"<p>Site</p><p>own {i}</p>" + "<p>Chance</p>" * (i < 8)) for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [out[i] for i in range(10)] == ["Whole text\nMore"] * 10
    assert [out[10 + i] for i in range(40)] == [f"own {i}" + "\nChance" * (i < 8) for i in range(40)]


def test_html_template_inside_articles(spark):
    """Boxes that recur in a host's articles under any class name go; an article on many pages stays."""
    box = "<div class=zz><p>Read our app</p></div>"
    rows = [*((f"http://f/{i}", f"<nav>n</nav><article><h1>T {i}</h1><p>own {i}</p>{box}</article>") for i in range(6))]
    rows += [(f"http://g/{i}", f"<nav>{i}</nav><main><div><h1>T</h1><p>Same</p></div></main>") for i in range(8)]
    rows += [(f"http://h/{i}", f"<article><p>own {i}</p>" + "<p>Chance</p>" * (i < 8) + "</article>") for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [out[i] for i in range(6)] == [f"T {i}\nown {i}" for i in range(6)]
    assert [out[6 + i] for i in range(8)] == ["T\nSame"] * 8
    assert [out[14 + i] for i in range(40)] == [f"own {i}" + "\nChance" * (i < 8) for i in range(40)]


def test_ids_stay_exact_beside_nulls(spark):
    """Integers beyond 2^53 with a null in the same batch."""
    import public_tokenizers as p

    big, text = 2**60 + 1, words(40)
    rows = [(big, text, "en", float("nan"), 2**60 + 3), (None, text, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, x double, y long").coalesce(1)
    bench = spark.createDataFrame([(big, text), (None, text)], "item_id long, text string").coalesce(1)
    ids = lambda out, c="doc_id": sorted({r[c] for r in out.collect()}, key=str)
    want = [big, None]
    kept = quality.quality(df).collect()
    assert {(r["doc_id"], r["y"]) for r in kept} == {(big, 2**60 + 3), (None, None)}
    assert {r["x"] is None for r in kept} == {True, False}
    assert ids(bpe.encode(df, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)) == want
    assert ids(html.extract(df.withColumnRenamed("text", "html").withColumn("url", F.lit("http://a/")))) == want
    assert ids(minhash.near_duplicates(df)) == want and ids(katz.Katz(df).score()) == want
    found = decontaminate.overlaps(df, bench)
    assert ids(found) == want and ids(found, "item_id") == want
    longer = df.withColumn("text", F.concat(F.lit(words(60)), F.lit("\n"), "text"))
    assert ids(lines.document_lines(longer)) == want and ids(lines.repeated_lines(longer)) == [big]


def _brute_log2_ppl(texts):
    """log2 of the perplexity of each text under modified Kneser-Ney of the reference texts, by dictionaries and recursion."""
    from collections import Counter, defaultdict
    from functools import cache
    from math import log2

    grams = []
    for t in texts:
        x = [0, 0, 0, *map(ord, t or ""), 0]
        grams.append([tuple(x[i : i + 4]) for i in range(len(x) - 3)])

    def teaches(t):
        w = t.split()
        letters = [c for c in t if c.isascii() and c.isalpha()]
        symbols = sum(c in "#*$%&|<>" for c in t)
        return symbols <= 0.1 * len(w) and sum(any(c.isalpha() for c in x) for x in w) >= 0.8 * len(w) and sum(c.isupper() for c in letters) <= 0.3 * len(letters)

    counts = {4: Counter(g for gs, t in zip(grams, texts) if t and quality.text_rules(t)[0] >= 20 and 100 * quality.text_rules(t)[4] <= 30 * quality.text_rules(t)[0] and teaches(t) for g in gs)}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: quality.discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    total, freed = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            freed[k, g[:-1]] += cut[k][min(n, 3)]

    @cache
    def prob(g):
        k = len(g)
        if not k:
            return 2.0**-16
        n, all_ = counts[k][g], total.get((k, g[:-1]), 0)
        return max(n - cut[k][min(n, 3)], 0) / all_ + freed[k, g[:-1]] / all_ * prob(g[1:]) if all_ else prob(g[1:])

    return [-sum(log2(prob(g)) for g in gs) / len(gs) for gs in grams]


def _brute_pipeline(docs, items, tokenize):
    """doc_id -> (n_chars, token ids) by plain loops, and how many documents the perplexity band rejects."""
    left, ppl = {}, dict(zip((d for d, _ in docs), _brute_log2_ppl([t for _, t in docs]), strict=True))
    for d, t in docs:
        w = (t or "").split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        again = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w):
            left[d] = t
    bins = sorted(int(ppl[d] / quality.BIN + 0.5) * quality.BIN for d in left)
    q1, q2, q3 = (next(b for i, b in enumerate(bins, 1) if i >= p * len(bins)) for p in (0.25, 0.5, 0.75))
    spread = max(q3 - q1, quality.MIN_SPREAD)
    n = len(left)
    left = {d: t for d, t in left.items() if q2 - quality.LOWER * spread <= ppl[d] <= q2 + quality.UPPER * spread}
    rejected = n - len(left)
    first, lost = {}, set()
    for d in sorted(left):
        ls = [(i, x) for i, x in enumerate(left[d].split("\n")) if x.split()]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(x.split()) for _, x in ls[a:b]) >= 50 and first.setdefault(tuple(x for _, x in ls[a:b]), (d, a)) != (d, a):
                    lost |= {(d, i) for i, _ in ls[a:b]}
    cut = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in lost) for d, t in left.items()}
    left = {d: t for d, t in cut.items() if t.split()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in left.items()}
    root = {d: d for d in left}
    for _ in root:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    left = {d: t for d, t in left.items() if root[d] == d}

    def leaks(text, item):
        a, b = text.lower().split(), item.lower().split()
        n = min(17, len(b))
        return any(sum(x == y for x, y in zip(a[i : i + n], b[j : j + n])) >= min(12, 0.8 * len(b)) for i in range(len(a)) for j in range(len(b) - n + 1))

    return {d: (len(t), tokenize(t)) for d, t in left.items() if not any(leaks(t, x) for x in items)}, rejected


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as p
    import tiktoken

    passage, items = words(60), [words(25), words(18)]
    base = [words(random.randrange(60, 120)) for _ in range(40)]
    noise = " ".join("".join(random.choice("qzxjwvQ@#~^{}789") for _ in range(5)) for _ in range(50))
    texts = [
        *base, base[0], base[1] + " tail", base[2] + " x", *(words(30) + "\n" + passage + "\n" + words(25) for _ in range(3)), base[3] + " " + items[0] + " " + words(9), items[1] + " " + words(40),
        "too short", None, "", " ".join([words(10)] * 9), noise, " ".join("~" * k for k in range(1, 60)), base[4] + "\n" + base[5],
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    path = p.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocabulary(path)[0])}, special_tokens={})
    want, rejected = _brute_pipeline(list(enumerate(texts)), items, ref.encode_ordinary)
    got = {r["doc_id"]: (r["n_chars"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 40 <= len(want) < len(texts) and rejected


def test_pipeline_on_the_small_table(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "text" not in out.columns
