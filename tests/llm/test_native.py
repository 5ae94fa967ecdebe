"""Chat formatting, mixing and URL filters against plain Python."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from mediashelf.llm import chat, mixing, url_filter
from pyspark.sql import functions as F


def rendered(turns, me):
    text, own = "", []
    for role, said in turns:
        text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == me else f"<|user:{role}|>\n"
        if role == me:
            own.append((len(text), len(text) + len(said) + 7))
        text += said + "<|end|>\n"
    return text, own


@pytest.mark.parametrize("block", [64, 3])
def test_perspectives(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng, rows = random.Random(1), []
    for conv in (1, 2, 3, None):
        rows += [(conv, t, rng.choice(["ann", "bob", "cy", "system", None]), f"say {t} " * rng.randint(0, 3))
                 for t in range(rng.randint(1, 15))]
    rows += [(4, 0, "system", "alone"), (5, None, "ann", None), (5, 1, "ann", "end <|end|>"), (5, 1, "ann", "end <|end|>")]
    frame = spark.createDataFrame([(*r, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    found = defaultdict(list)
    for r in chat.rotate(frame).collect():
        found[r.conv_id, r.perspective].append(r)
    clean = lambda s: (s or "").replace("<|", "< |")
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), clean(s), clean(x)) for c, t, s, x in rows if c == conv)
        turns = [(s, x) for _, s, x in turns]
        for me in {s for s, _ in turns if s != "system"}:
            want[conv, me] = rendered(turns, me)
    assert found.keys() == want.keys()
    for key, parts in found.items():
        parts.sort(key=lambda r: r.part)
        text, own = want[key]
        assert "".join(r.rendered for r in parts) == text
        assert [r.start for r in parts] == [sum(len(p.rendered) for p in parts[:i]) for i in range(len(parts))]
        spans = [(r.start + a, r.start + b) for r in parts for a, b in zip(r.mask_starts, r.mask_ends)]
        assert spans == own
        assert all(text[b - 7:b] == "<|end|>" for _, b in own)
        assert all(r.n_turns <= block for r in parts)
    assert chat.rotate(frame.where("turn > 99")).count() == 0


def shares(children, budget):
    """Water-filling: (weight, capacity) by name, whole tokens rounded down."""
    order = sorted(children, key=lambda n: (Fraction(children[n][1], children[n][0]), n))
    left, weight, out = budget, sum(w for w, _ in children.values()), {}
    for i, n in enumerate(order):
        w, cap = children[n]
        if cap * weight <= left * w:
            out[n], left, weight = cap, left - cap, weight - w
        else:
            for m in order[i:]:
                out[m] = min(children[m][1], children[m][0] * left // weight)
            break
    return out


@pytest.mark.parametrize("slice_rows", [1_000, 4])
def test_mixture(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rng = random.Random(3)
    rows = [(i, rng.choice("AAAB"), rng.choice(["en", "en", "de", None]), rng.choice("xyyyz"), rng.randint(0, 30))
            for i in range(300)]
    rows += [(299, *rows[299][1:]), (None, "A", "en", "x", 5), (400, "B", "fr", "z", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, dom string, lang string, src string, tok bigint")
    weights = {"domain": {"A": 1, "B": 2}, "language": {"en": 3, "de": 1, None: 2}, "source": {"x": 5, None: 1, "q": 0}}
    found = mixing.mix(frame, weights, (7, 10), F.col("tok"), F.col("dom"), F.col("lang"), F.col("src"), seed=4, max_epochs=3)
    assert found.columns == [*frame.columns, "mix_domain", "mix_epoch", "mix_tokens"]
    leaves = defaultdict(list)
    for i, d, lang, s, n in rows:
        leaves[d, lang or "", s].append((i, n or 0))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level, n: weights[level].get(n, weights[level].get(None, 0))
    plan = {(): sum(size.values()) * 7 // 10}
    for depth, level in enumerate(mixing.LEVELS):
        below = {}
        for parent, budget in plan.items():
            names = {k[depth] for k in leaves if k[:depth] == parent}
            caps = {n: (weight(level, n), 3 * sum(v for k, v in size.items() if k[:depth + 1] == (*parent, n))) for n in names}
            below |= {(*parent, n): b for n, b in shares({n: c for n, c in caps.items() if c[0]}, budget).items()}
        plan = below
    want = defaultdict(int)
    for leaf, budget in plan.items():
        if not size[leaf]:
            continue
        whole, rest = divmod(budget, size[leaf])
        key = lambda i, e: hashlib.md5(f"4|{e}|{'' if i is None else i}".encode()).hexdigest()
        for i, _ in leaves[leaf]:
            for e in range(1, whole + 1):
                want[i, e] += 1
        done = 0
        order = sorted(leaves[leaf], key=lambda r: key(r[0], whole + 1))
        for i in dict.fromkeys(i for i, _ in order):
            same = [n for j, n in order if j == i]
            done += sum(same)
            if rest and done <= rest:
                want[i, whole + 1] += len(same)
            else:
                break
    got = defaultdict(int)
    for r in found.collect():
        got[r.doc_id, r.mix_epoch] += 1
    assert got == want
    assert sum(r.mix_tokens for r in found.collect()) <= plan_total(size)
    assert mixing.mix(frame.where("doc_id > 999"), weights, (1, 2), F.col("tok"), F.col("dom"), F.col("lang"), F.col("src")).count() == 0


def plan_total(size):
    return sum(size.values()) * 7 // 10


@pytest.mark.parametrize("tokens,share", [(250_000_000, (4, 5)), (600_000_000, (7, 4)), (1 << 40, (4, 5))])
def test_mixture_of_very_many_tokens(spark, tokens, share):
    frame = spark.createDataFrame([(i,) for i in range(4)], "doc_id bigint").withColumn("n", F.lit(tokens).cast("bigint"))
    one = {level: {None: 1} for level in mixing.LEVELS}
    found = mixing.mix(frame, one, share, F.col("n"), F.lit("A"), F.lit("en"), F.lit("x"))
    assert found.count() == 4 * share[0] // share[1]


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    fits = [(len(h), len(p), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("prefix", [8, 1])
def test_urls(spark, monkeypatch, prefix):
    monkeypatch.setattr(url_filter, "PREFIX_HEX", prefix)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/e", "block"),
             ("net", "", "allow"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")]
    urls = [None, "", "no scheme", "http://", "https://COM", "http://com/", "http://a.com/x?y#z", "HTTP://Example.Com/en/a",
            "http://www.example.com/en/", "http://example.com/en", "http://xexample.com/en/", "http://a.net/english",
            "http://a.net?x=/e", "http://net#f", "http://u:p@b.net:80/e", "http://.com/", "http://com./", "http://dup.org/a",
            "http://ÄB.com/É", "http://a.com/" + "p/" * 3000, "x://y://z.com/", "http://a.com/q\nr", "http://a.com/x?y#z"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    frame = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, frame).collect()}
    assert found == {i: judged(u, rules) for i, u in enumerate(urls)}
    none = url_filter.judge_urls(pages, frame.where("host = '-'"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"} and none.count() == len(urls)
    assert url_filter.judge_urls(pages.where("page_id < 0"), frame).count() == 0


def test_urls_with_very_long_hosts(spark):
    """Suffixes are made only for the label counts that rules have."""
    rules = spark.createDataFrame([("com", "/", "block"), ("b.example.org", "/x", "block")], "host string, path string, verdict string")
    long = "a." * 400_000
    rows = [(1, f"http://{long}com/"), (2, f"http://{long}b.example.org/xy"), (3, f"http://{long}net/"), (4, "http://org/x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert found == {1: ("com/", "block"), 2: ("b.example.org/x", "block"), 3: (None, "allow"), 4: (None, "allow")}
