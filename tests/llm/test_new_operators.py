"""Operators 11 to 13 against brute force and against their SQL."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.llm import merkle, queries, repair, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair", "op13_url_filters"])
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    wanted = con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, wanted))


# 11
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels from the leaves to the root, and for each leaf the siblings before and after it, level by level."""
    levels, paths = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        for k in range(len(leaves)):
            i = k // 3 ** (len(levels) - 1)
            run = i - i % 3
            paths[k].append((below[run:i], below[i + 1 : run + 3]))
        levels.append([digest(*below[k : k + 3]) for k in range(0, len(below), 3)])
    return levels, paths


def brute_manifest(docs):
    """docs: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for d in docs:
        sources.setdefault(d[1], []).append(d)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        rows = sorted(sources[name], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[name] = rows, *tree([leaf(d) for d in rows])
    tops, top_paths = tree([trees[name][1][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        rows, levels, paths = trees[name]
        for d, path in zip(rows, paths, strict=True):
            text = d[4]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded, proof = leaf((*d[:4], text)), []
            for before, after in path + top_paths[at]:
                folded = digest(*before, folded, *after)
                proof += before + after
            out.append((d[0], leaf(d), levels[-1][0], tops[-1][0], digest(*proof), folded, folded == tops[-1][0]))
    return sorted(map(str, out))


def test_manifest(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "a", "b\nc", "\n", "é😀\nz", "x" * 20_000])
    docs = [(k, "big", rng.choice(["en", None]), rng.choice([k, None]), text()) for k in range(-5, 800)]  # two rounds of builders
    docs += [(k, rng.choice([None, "", "one", "Zé", "z"]), "de", 1, text()) for k in range(1000, 1040)] + [(5, "alone", None, None, None)]
    docs += [(None, "big", "en", 3, "n\nn"), (None, "big", "en", 3, "n\nn"), (None, None, None, None, None), (7, "big", "en", 1, "twice"), (7, "big", "en", 1, "twice"), (7, "big", "en", 2, "again\n")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("tree", "i", "n", "hash", "segment", "level", "root")})
    got = merkle.manifest(merkle.leaf_table(df.repartition(5)))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    (r,) = merkle.manifest(merkle.leaf_table(df.where("source = 'alone'"))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == digest()
    assert merkle.manifest(merkle.leaf_table(df.limit(0))).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "s", "x\n"), ("a", "s", "y\n"), (None, "s", "z")], "doc_id string, source string, text string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(2)})
    out = {r["doc_id"]: r for r in merkle.manifest(merkle.leaf_table(docs)).collect()}
    assert set(out) == {"a", "b", None} and {r["root"] for r in out.values()} == {digest(*(out[k]["leaf"] for k in (None, "a", "b")))}


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 28, 82, 100, 243, 244])
def test_positions_are_the_postorder(leaves):
    """A stack of the nodes that are open writes the same order."""
    written = []

    def write(level, i):
        if level:
            for k in range(3):
                if (3 * i + k) * 3 ** (level - 1) < leaves:
                    write(level - 1, 3 * i + k)
        written.append((level, i))

    write(merkle.height(leaves), 0)
    assert [int(merkle.positions(level, np.array([i]), leaves)[0]) for level, i in written] == list(range(len(written)))


def test_logs_are_written_in_order_of_completion(spark):
    rows = spark.range(1000).selectExpr("'t' AS tree", "id AS doc_id", "sha2(cast(id AS string), 256) AS hash", "cast(null AS string) AS tampered")
    numbered, most = merkle.ordered(rows, ["doc_id", "hash"])
    rounds = merkle.build_logs(numbered.withColumn("doc_id", F.col("doc_id").cast("string")), most)
    assert len(rounds) == 2
    for part in rounds[0].select("segment", "position").collect(), rounds[1].select("segment", "position").collect():
        by = {}
        for r in part:
            by.setdefault(r["segment"], []).append(r["position"])
        assert all(p == sorted(p) for p in by.values())
    first = [r["position"] for r in rounds[0].where("segment = 0").collect()]
    assert first == list(range((3**7 - 1) // 2))  # an aligned builder's part is one run of the log


# 12
def all_repairs(rows):
    """Every sensible edit of (role, text, must, cut): yields cost, audit, repaired rows. At most two inserts stand at one place."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(k, last, cost, audit, out, inserts):
        if k == len(rows) and last in ("", "a"):
            yield cost, audit, out
        if inserts < 2:
            for role in ("user", "assistant"):
                if role[0] in follow[last]:
                    yield from go(k, role[0], cost + 3, audit + "I", [*out, (role, "")], inserts + 1)
        if k < len(rows):
            role, text, must, cut = rows[k]
            yield from go(k + 1, last, cost + 4, audit + "D", out, 0)
            if not must:
                if role[:1] and role[0] in follow[last]:
                    yield from go(k + 1, role[0], cost + 3 * cut, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        yield from go(k + 1, new[0], cost + 3 + 3 * cut, audit + "R", [*out, (new, text)], 0)

    return min(go(0, "", 0, "", [], 0))


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = not blank and (role, text) in seen
        cut = not blank and not again and re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?"
        seen.add((role, text))
        out.append((blank, again, cut))
    return out


def test_cheapest_edits_and_least_audits():
    rng = random.Random(5)
    made = [[(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]), rng.choice(["one.", "two!", "cut", "", " \n", "three?\t"]) if rng.random() < 0.6 else f"t{rng.random()}.") for _ in range(rng.randint(0, 6))] for _ in range(400)]
    flags = [faults(rows) for rows in made]
    kind = lambda role: {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
    column = lambda f: pd.Series([np.array([f(*x) for x in zip(rows, fl, strict=True)], dtype=object) for rows, fl in zip(made, flags, strict=True)])
    got = repair.repaired_batch(column(lambda r, f: kind(r[0])), column(lambda r, f: f[0]), column(lambda r, f: r[1].strip(" \t\n")[-1:] not in (".", "!", "?")), column(lambda r, f: f"{len(r[0])}:{r[0]}{r[1]}"))
    for rows, fl, g in zip(made, flags, got.itertuples(), strict=True):
        cost, audit, out = all_repairs([(*r, f[0] or f[1], f[2]) for r, f in zip(rows, fl, strict=True)])
        assert (g.cost, g.audit, g.blank, g.duplicate, g.truncated) == (cost, audit, *(sum(f[k] for f in fl) for k in range(3)))
        assert [(p["role"] or rows[p["row"]][0], "" if p["row"] < 0 else rows[p["row"]][1]) for p in g.plan] == out


def test_least_audit_of_one_very_long_conversation():
    n = 20_000
    one = lambda x: pd.Series([x])
    kinds = np.array([2, 3] * (n // 2))
    kinds[n // 2] = 0
    got = repair.repaired_batch(one(kinds), one(np.zeros(n, bool)), one(np.zeros(n, bool)), one(np.array([str(k) for k in range(n)], dtype=object)))
    assert got["cost"][0] == 3 and got["audit"][0] == "K" * (n // 2) + "R" + "K" * (n // 2 - 1)
    assert repair.repaired_batch(*[pd.Series([], dtype=object)] * 4).empty


def brute_repair(rows):
    """rows: (conv_id, turn, role, text) to one tuple for each conversation."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, turns in convs.items():
        left = []
        for turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())):
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            left += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        known = [t for t, _, _ in left if t is not None]
        pairs = [(r, t) for _, r, t in left]
        fl = faults(pairs)
        cost, audit, fixed = all_repairs([(*p, f[0] or f[1], f[2]) for p, f in zip(pairs, fl, strict=True)])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        out.append((c, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(f[k] for f in fl) for k in range(3)), illegal, cost, audit, digest("\n".join(f"{r}:{t}" for r, t in fixed))))
    return sorted(map(str, out))


def test_repair_of_odd_rows(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([None, k, k + 3, 100 + k]), rng.choice(["system", "user", "assistant", None, "", "tool"]), rng.choice([None, "", "Yes.", "no", "é!", "e" * 30_000 + ".", "Yes."])) for c in [*range(60), None] for k in range(rng.randint(1, 5))]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("copies", "rows", "run", "p", "cost")})
    got = repair.repaired(repair.damaged(df.repartition(3)))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    assert sorted(str(tuple(r)) for r in got.withColumn("s", F.sha2(said, 256)).drop("messages").collect()) == brute_repair(rows)
    assert repair.repaired(repair.damaged(df.limit(0))).count() == 0
    long = [(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(500)]
    (r,) = repair.repaired(repair.damaged(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).collect()
    assert [m["role"][0] for m in r["messages"]] == ["u", "a"] * (len(r["messages"]) // 2) and len(r["messages"]) > 300
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (r,) = repair.repaired(repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", [])


# 13
ODD_URLS = [
    None, "", "no host", "http://net/", "http://net", "http://NET/x", "http://internet/", "https://a.b.net/en/?q=/en/", "https://Example.NET/en/1", "https://example.net/EN/1", "https://example.net?x=/en/", "x://y://net/", "http://user@example.com/de/",
    "http://example.com:80/de/", "https://a.example.com/de/#f", "http://a.org/fr/", "http://ads.example.org/", "http://x.ads.example.org/", "http://loads.example.org/", "https://m.casino-royale.example.org/", "https://casino.example.org/", "http://x.example.org/Casino/",
    "http://x.example.org/a.jpg", "http://x.example.org/a.jpg?b", "http://x.example.org/a.jpgs", "http://x.example.org/feed", "http://x.example.org/feed\n", "http://x.onion/", "http://x.example.org/?PHPSESSID=1", "http://é.example.org/spam", "://", "http://x.example.org/wiki/x/poker/", "http://x.example.org/" + "a/" * 20_000,
]


def brute_url(url):
    host, path, rest = "", "", ""
    if url is not None and "://" in url:
        tail = url.split("://", 1)[1]
        host, rest = re.fullmatch(r"([^/?#]*)(.*)", tail, re.S).groups()
        path = re.match("[^?#]*", rest)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in urls.SITES for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    site = max(fit, key=lambda r: len(r.name)) if fit else None
    own = [r for r in urls.RULES if r.level == 1 and re.search(r.regex.replace(r"\z", r"\Z"), host + rest, re.ASCII)]
    first = min(own, key=lambda r: (r.action, r.name)) if own else None
    return host, path, site and site.name, (site or first).action if site or first else "allow", None if site else first and first.name


def test_urls(spark):
    pages = [(k, u) for k, u in enumerate(ODD_URLS)] + [(None, "http://net/"), (1, "http://net/"), (1, "http://net/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "token", "rule", "name", "level", "site", "html")})
    got = urls.judged(df, urls.rule_table(spark, urls.RULES))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((k, *brute_url(u))) for k, u in pages)
    assert urls.judged(df.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]


def test_every_address_that_a_rule_fits_has_its_tokens():
    rng = random.Random(2)
    pieces = sorted({t for r in urls.RULES for t in r.tokens}) + list("/.-?=&^*;,:_") + ["example", "xx", "BETS"]
    tried = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    tried += [r.pattern.replace("*", rng.choice(["", "q", "/"])).replace("^", rng.choice("/.-?")).replace("|", "") for r in urls.RULES]
    hits = 0
    for address in tried:
        tokens = {t.lower() for t in re.findall(urls.TOKEN, address)}
        for r in urls.RULES:
            if re.search(r.regex.replace(r"\z", r"\Z"), address, re.ASCII):
                hits += 1
                assert tokens.issuperset(r.tokens), (address, r.pattern)
    assert hits > 100


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [urls.UrlRule("a", "block", "/common/rare/"), urls.UrlRule("b", "block", "/common/never/"), urls.UrlRule("c", "block", "*loose*"), urls.UrlRule("d", "block", "/common/")]
    tokens = spark.createDataFrame([("common",), ("common",), ("rare",)], "token string")
    index = {r["name"]: r["token"] for r in urls.rarest_index(urls.rule_table(spark, rules), tokens).collect()}
    assert index == {"a": "rare", "b": "never", "c": "", "d": "common"}
    df = spark.createDataFrame([(1, "http://h/x-loosely"), (2, "http://h/common/rare/"), (3, "http://h/y")], "page_id long, url string")
    assert {r["page_id"]: r["pattern"] for r in urls.judged(df, urls.rule_table(spark, rules)).collect()} == {1: "c", 2: "a", 3: None}
