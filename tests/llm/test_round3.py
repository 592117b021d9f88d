"""Operators 11 to 13 against brute force."""

import itertools
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, html, pii, quality, repair, simhash, spelling

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# operator 13


def plain_fingerprint(text, width=3):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    """prints: (doc_id, fingerprint) rows -> smallest doc_id of each fingerprint's component."""
    every = sorted({f for _, f in prints})
    array, root = np.array(every, np.uint64), list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(array):
        for j in np.flatnonzero(np.bitwise_count(array ^ f) <= bits).tolist():
            root[find(j)] = find(i)
    least = defaultdict(lambda: None)
    at = {f: find(i) for i, f in enumerate(every)}
    for d, f in prints:
        if d is not None:
            least[at[f]] = d if least[at[f]] is None else min(least[at[f]], d)
    return {f: least[at[f]] for f in every}


def check_simhash(spark, rows, schema="doc_id bigint, text string", **more):
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema), **more).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    found = plain_components(prints)
    want = Counter((d, f"{f:016x}", found[f]) for d, f in prints)
    assert Counter(map(tuple, got)) == want
    return got


def test_simhash_documents(spark):
    rows = documents(spark)
    got = simhash.op13_simhash(spark, SF).collect()
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    found = plain_components(prints)
    assert {tuple(r) for r in got} == {(d, f"{f:016x}", found[f]) for d, f in prints}
    assert len(got) == len(rows)


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "A b C d"), (2, "a b c d"), (3, None), (4, ""), (5, " \t\n"), (None, "a b c d"), (None, None), (6, "one"), (7, "one two"), (7, "other"), (8, long), (9, long + " x"), (-5, "ONE"), (6, "one"), (10, "a b c  d e")]
    check_simhash(spark, rows)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    extra = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id bigint, text string, fp string, cell int, component_id int")
    assert simhash.near_duplicates(extra).columns == ["doc_id", "fingerprint", "component_id"]


def test_simhash_crowded_cells(spark):
    """Chains and a tight ball of fingerprints, cells and chunks of a few members."""
    rng = np.random.default_rng(5)
    some = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flipped = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in some[:150] for a, b in [rng.integers(0, 64, 2)]]
    ball = [int(some[0]) ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in itertools.combinations(range(0, 64, 5), 3)]
    prints = sorted({*map(int, some), *flipped, *ball})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp bigint")
    dealt = simhash.cells(df, 2, 20)
    assert dealt.select("cell").distinct().count() > 5
    assert dealt.select("fp").distinct().count() == len(prints)
    links = simhash.links(dealt, 2, 20).collect()
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = (int(np.int64(v).view(np.uint64)) for v in (a, b))
        assert (a ^ b).bit_count() <= 2
        root[find(a)] = find(b)
    want = plain_components([(x, x) for x in prints])
    least = {}
    for x in prints:
        least[find(x)] = min(least.get(find(x), x), x)
    assert {x: least[find(x)] for x in prints} == want


# operator 11


def plain_variants(rows, ratio=10):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    by_gap = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for key, members in by_gap.items():
        for (a, i), (b, j) in itertools.combinations(members, 2):
            if a != b and i == j:
                near[a].add(b)
                near[b].add(a)
        if key in words:
            for a, _ in members:
                near[a].add(key)
                near[key].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def check_variants(spark, rows, **more):
    got = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"), **more).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_variants(rows)
    return got


def test_variants_documents(spark):
    got = spelling.op11_spelling_variants(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == plain_variants(documents(spark))
    assert any(r["form"] for r in got)


def test_variants_edges(spark):
    long = "ab" * 9000
    rows = [(1, "Abcdefg abcdefg " * 12 + "abcdefh abcdefh abcdefgh abcdefgh abcdeg bcdefgh bcdefgh"), (2, None), (3, ""), (None, "ÀBCDEFGÿ ÀBCDEFGÿ abcdefg"), (4, f"{long} {long} {long}c {long}c x{long} x{long}"), (5, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa aaabaaa aaabaaa"), (5, "aaaaaaa aaaaaaa")]
    check_variants(spark, rows)
    # a chain of forms, counts rising tenfold
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate([("wortschatz", 2), ("wortschatx", 20), ("wortschaty", 20), ("wortschay", 200), ("wortscha", 2000)])]
    assert any(r["root"] != r["form"] and r["form"] for r in check_variants(spark, rows))
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    extra = spark.createDataFrame([(1, "abcdefg abcdefg", "x", 1)], "doc_id bigint, text string, word string, n int")
    assert spelling.variants(extra).count() == 1


def test_variants_crowded_chunks(spark):
    """Thousands of words that share their ends, groups of a few words."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdé"))
    words = {"pre" + "".join(rng.choice(letters, 4)) for _ in range(400)} | {"".join(rng.choice(letters, rng.integers(3, 6))) + "tion" for _ in range(400)} | {"abab" * k + x for k in range(2, 9) for x in ("", "a", "b", "ba")}
    rows = [(i, " ".join([w] * int(rng.choice([2, 3, 40])))) for i, w in enumerate(sorted(words))]
    check_variants(spark, rows, group=4)


# operator 12


def plain_cheapest(rows, start="0", ends="0a"):
    """Bellman-Ford over (cost, audit)."""
    best = {(0, start): (0, "")}
    queue = [(0, start)]
    while queue:
        node = queue.pop()
        i, s = node
        cost, audit = best[node]
        due = "a" if s == "u" else "u"
        steps = [("I", 3, (i, due))] if cost < 4 * len(rows) + 12 else []
        if i < len(rows):
            role, gone, truncated = rows[i]
            steps.append(("D", 4, (i + 1, s)))
            if not gone:
                if role == due or role == "s" and s == "0":
                    steps.append(("K", 3 * truncated, (i + 1, role)))
                steps.append(("R", 3 + 3 * truncated, (i + 1, due)))
        for edit, more, to in steps:
            new = (cost + more, audit + edit)
            if to not in best or new < best[to]:
                best[to] = new
                queue.append(to)
    return min((best[(len(rows), e)] for e in ends if (len(rows), e) in best), default=None)


ROW = st.tuples(st.sampled_from(["u", "a", "s", "x", ""]), st.booleans(), st.booleans())


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=7), st.sampled_from("0sua"), st.sampled_from(["0a", "0", "s", "u", "a"]))
def test_cheapest(rows, start, ends):
    assert repair.cheapest(rows, start, ends) == plain_cheapest(rows, start, ends)


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Damaged rows (conv_id, turn, role, text) -> figures of each conversation."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r, x))
    out = {}
    for c, turns in by.items():
        turns.sort()
        seen, lattice, kinds = set(), [], Counter()
        for _, _, r, x in turns:
            body = x.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "fine"
            seen.add((r, x))
            kinds[kind] += 1
            lattice.append((r[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        cost, audit = plain_cheapest(lattice)
        fixed, i, s = [], 0, "0"
        for e in audit:
            due = "a" if s == "u" else "u"
            if e == "I":
                fixed.append(("user" if due == "u" else "assistant", ""))
                s = due
                continue
            _, _, r, x = turns[i]
            i += 1
            if e != "D":
                s = r[:1] if e == "K" else due
                fixed.append((r if e == "K" else "user" if due == "u" else "assistant", x))
        assert i == len(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
        known = [t for there, t, _, _ in turns if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[c] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest())
    return out


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_repair(plain_damage(rows))
    got = repair.op12_conversation_repair(spark, sf).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[c] for c in FIGURES) == want.get(r["conv_id"], (0, 0, 0, 0, 0, 0, "", sha256().hexdigest()))


MESSY = [
    (None, None, "user", "hi."), (None, 3, "assistant", "yes"), (None, 3, "assistant", "yes"), (7, None, None, None), (7, None, "system", "s."), (7, 9, "", "text."), (7, 2, "tool", "ünï."), (7, 2, "user", " \n"),
    (8, 1, "user", "a."), (8, 5, "user", "a."), (8, 5, "user", "a."), (8, 6, "assistant", "b. \t"), (9, 1, "system", "only."), (10, 1, "assistant", "x" * 300_000),
]


@pytest.mark.parametrize("size", [1, 2, 512])
def test_repair_edges(spark, size):
    long = [(11, i, ["user", "assistant", "user", "system"][i * i % 4], f"t{i % 37}{'.' if i % 5 else ''}") for i in range(90)]
    rows = MESSY + long
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    given_ = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = repair.repaired(df, size).collect()
    assert {r["conv"]: tuple(r[c] for c in FIGURES) for r in got} == {"" if c is None else str(c): v for c, v in plain_repair(given_).items()}
    extra = df.withColumns({"part": F.lit(1), "n": F.lit("x"), "conv": F.lit(2)})
    damaged = repair.repaired(repair.damaged(extra), size).collect()
    assert {r["conv"]: tuple(r[c] for c in FIGURES) for r in damaged} == {"" if c is None else str(c): v for c, v in plain_repair(plain_damage(rows)).items()}


def test_repair_empty(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


# operator 10


def plain_tree(rng, host, page):
    """A page as nested (tag, class, kids)."""
    words = lambda n: " ".join(f"w{rng.integers(0, 400)}" for _ in range(n))
    own = lambda tag="p": (tag, "", [words(3), ("b", "", [words(1)]), words(2)])
    box = lambda k: ("div", f"c{k}", [("p", "", [f"box {host} {k}"]), ("section", "", [("p", "", [f"more {host} {k}"]), " tail "])])
    some = lambda n: [own() if rng.random() < 0.7 else box(int(rng.integers(0, 3))) if rng.random() < 0.7 else ("ul", "", [("li", "", [words(2)]), ("li", "", [own()])]) for _ in range(n)]
    top = [("nav", "", [("p", "", ["menu"])]), box(0) if rng.random() < 0.8 else own("div")]
    body = [("article", "", [("h1", "", [words(2)]), *some(4), ("aside", "", ["aside"]), ("div", "ad", [("p", "", ["buy"])]), box(1)])] if rng.random() < 0.6 else some(3)
    return ("body", "", [*top, *body, ("footer", "", [("p", "", [f"foot {host}"])])])


def written(node):
    tag, name, kids = node
    return f"<{tag}{f' class={name}' if name else ''}>" + "".join(k if isinstance(k, str) else written(k) for k in kids) + f"</{tag}>"


COUNTED = {"p", "div", "section", "ul", "li", "h1", "nav", "footer", "aside"}
GONE = {"nav", "footer", "aside"}


def plain_page(root):
    """(pieces with the canonical elements around them, canonical elements outside articles)."""
    gone = lambda n: n[0] in GONE or n[1] == "ad"

    def articles(n):
        if gone(n):
            return []
        return [n] if n[0] == "article" else [a for k in n[2] if not isinstance(k, str) for a in articles(k)]

    regions = articles(root) or [root]

    def canonical(n):
        if n[0] == "article":
            return ("article",)
        return (n[0], *[k if isinstance(k, str) else canonical(k) for k in n[2]])

    outside = set()

    def look(n):
        if n[0] == "article":
            return
        if n[0] in COUNTED:
            outside.add(canonical(n))
        for k in n[2]:
            if not isinstance(k, str):
                look(k)

    look(root)
    pieces, now = [], []

    def close(around):
        if line := " ".join("".join(now).split()):
            pieces.append((line, around))
        now.clear()

    def walk(n, around):
        for k in n[2]:
            if isinstance(k, str):
                now.append(k)
            elif not gone(k):
                if k[0] == "b":
                    walk(k, around)
                else:
                    close(around)
                    inner = around | {canonical(k)} if k[0] in COUNTED else around
                    walk(k, inner)
                    close(inner)

    for r in regions:
        walk(r, frozenset())
        close(frozenset())
    return pieces, outside


def test_html_against_brute_force(spark):
    rng = np.random.default_rng(11)
    pages = [(f"host{h}", plain_tree(rng, h, i)) for h, n in enumerate((1, 4, 6, 30, 60)) for i in range(n)]
    pages += [pages[5]] * 6
    seen = [plain_page(t) for _, t in pages]
    whole = ["\n".join(t for t, _ in p) for p, _ in seen]
    rows, contents, of = Counter(), defaultdict(set), defaultdict(set)
    for (h, _), (p, outside), text in zip(pages, seen, whole, strict=True):
        of[h].add(text)
        for e in set().union(outside, *(a for _, a in p)):
            rows[h, e] += 1
            contents[h, e].add(text)
    template = {(h, e) for (h, e), n in rows.items() if n >= 5 and len(contents[h, e]) >= max(5, 0.5 * len(of[h]))}
    want = ["\n".join(t for t, a in p if not any((h, e) in template for e in a)) for (h, _), (p, _) in zip(pages, seen, strict=True)]
    assert sum(a != b for a, b in zip(want, whole, strict=True)) > 50
    df = spark.createDataFrame([(i, f"http://{h}/{i}", written(t), h, i, "x") for i, (h, t) in enumerate(pages)], "page_id long, url string, html string, host string, row_id int, kept string").repartition(4)
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "host", "row_id", "kept", "text", "n_chars"]
    found = {r["page_id"]: r for r in got.collect()}
    assert [found[i]["text"] for i in range(len(pages))] == want
    assert all((r["host"], r["row_id"], r["kept"]) == (pages[i][0], i, "x") for i, r in found.items())


def test_html_deep_and_stray(spark):
    """Pages of a hundred thousand tags take linear time and memory."""
    n = 30_000
    rows = ["<div>a" * n, "<b>" * n + "</i>" * n + "x", "<b>" * n + "<div>y</div>" * n + "</b>" * n, "<article>" + "<b>" * n + "<p>z</i></u></p>" * n, "a " * 300_000]
    began = time.time()
    pages = [html.Page(h).parsed() for h in rows]
    assert time.time() - began < 60
    assert [len(p[0]) for p in pages] == [n, 1, n, n, 1]
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [out[i] for i in range(5)] == ["\n".join("a" * n), "x", "\n".join("y" * n), "\n".join("z" * n), ("a " * 300_000).strip()]


# clashing names, repeated rows, long keys, hot seeds and buckets of earlier operators


def test_quality_keeps_clashing_columns(spark):
    text = " ".join(f"wort{i % 37}" for i in range(60))
    df = spark.createDataFrame([(i, text, "de", i, 2.0, "x", 3) for i in range(5)], "doc_id long, text string, lang string, _low int, _high double, band_lang string, __low int")
    out = quality.quality(df)
    assert set(df.columns) <= set(out.columns)
    assert sorted((r["_low"], r["_high"], r["band_lang"], r["__low"]) for r in out.collect()) == [(i, 2.0, "x", 3) for i in range(5)]


def test_chat_repeated_messages_and_long_paths(spark):
    """A message given twice is one; a path of a thousand messages; a text of a million characters; a broad tree."""
    schema = "tree_id string, msg_id long, parent_id long, role string, text string, score double"
    twice = [("t", 1, None, "user", "q", 0.0)] * 2 + [("t", 2, 1, "assistant", "a", 1.0)] * 3 + [("t", 2, 1, "assistant", "b", 1.0)]
    path = [("p", i, i - 1 if i else None, ["user", "assistant"][i % 2], f"m{i}", 0.0) for i in range(1000)]
    broad = [("b", 0, None, "user", "x" * 1_000_000, 0.0)] + [("b", i, 0, "assistant", f"r{i}", float(i)) for i in range(1, 500)]
    got = {r["tree_id"]: chat.parse_conversation(r["formatted"]) for r in chat.format_paths(chat.reply_paths(spark.createDataFrame(twice + path + broad, schema))).collect()}
    assert got["t"] == [("user", "q"), ("assistant", "a")]
    assert got["p"] == [(["user", "assistant"][i % 2], f"m{i}") for i in range(1000)]
    assert got["b"] == [("user", "x" * 1_000_000), ("assistant", "r499")]


def test_long_secrets(spark):
    key = "".join(f"{i * i % 97:02d}aZ" for i in range(75)) + "q9"
    df = spark.createDataFrame([(1, f"token = {key}"), (2, f"api_key: {key * 40} end"), (3, "token " + "a" * 300)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in pii.find_pii(df).collect()}
    assert got == {1: [("secret", 8, 8 + len(key))], 2: [("secret", 9, 9 + 40 * len(key))], 3: []}


def test_decontamination_of_a_standing_phrase(spark, monkeypatch):
    """A phrase that all items and passages share, with keys of a few pairs and without."""
    phrase = " ".join(f"s{i}" for i in range(14))
    items = [(j, f"{phrase} q{j} r{j} t{j}") for j in range(40)]
    docs = [(i, f"x{i} y{i} {phrase} q{i % 50} end{i}") for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.overlaps(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == whole
    assert {(d, i) for d, i, *_ in whole} == {(d, i) for d in range(60) for i in range(40)}
