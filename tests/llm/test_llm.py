"""The numbered operators against brute force, round trips and hand-made cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, chat, decontaminate, jaccard, language, licenses, quality, sharding, substrings, toxicity
from wavemill.llm.common import WordHashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "abcdefghij" for b in ("la", "mo", "ri", "su", "te")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a shared passage, nulls, empty, blank, short and long texts, equal ids' ties."""
    rng = random.Random(1)
    long = prose(rng, 400)
    near = long.split()
    near[200] = "changed"
    passage = prose(rng, 30)
    texts = [long, long, " ".join(near), None, "", " \t\n", "That it.", "That it.", prose(rng, 50) + " " + passage, passage + "\n" + prose(rng, 25), "x " * 60, passage, "e" * 3000, prose(rng, 19), "&&& %%% 12"]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(20)]
    return [(k, t, ("en", "de", None)[k % 3], f"s{k % 2}" if k % 5 else None, 0) for k, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(corpus, DOCS).withColumns({c: F.lit(1) for c in ("size", "id", "key", "shard", "salt", "band", "score", "kept", "n_words", "rank", "cell", "e")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_chat_round_trip_and_states(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "a\\<|im_end|>\n<\\|x"), (1, 2, "assistant", "b<"), (1, 3, "user", None), (1, 4, "assistant", "\\|c"),
        (2, 0, "assistant", "first"), (3, None, "us\ner%", "<|"), (3, 1, None, ""), (4, 7, "user", "q"), (4, 7, "user", "q"), (None, 0, "user", "x"), (None, 1, "assistant", "é😀"),
    ]
    many = [(5, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(500)]
    df = spark.createDataFrame(turns + many, "conv_id long, turn long, role string, text string").withColumn("run", F.lit(1))
    made = rows(chat.format_conversations(df).withColumn("read", chat.parsed(F.col("formatted"))), "conv_id")
    assert {k: r["valid"] for k, r in made.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True}
    assert [tuple(t) for t in made[1]["read"]] == [(r, t or "") for _, _, r, t in turns[:5]]
    assert [tuple(t) for t in made[3]["read"]] == [("us\ner%", "<|"), ("", "")]
    assert [t["text"] for t in made[5]["read"]] == [f"t{k}" for k in range(500)]
    assert made[4]["n_turns"] == 2
    assert [s["text"] for s in made[None]["segments"] if s["loss"]] == ["é😀"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = sorted(range(4096), key=sharding.curve().__getitem__)
    assert sorted(sharding.curve()) == list(range(4096))
    at = lambda k: (k // 256, k // 16 % 16, k % 16)
    assert all(sum(abs(x - y) for x, y in zip(at(a), at(b), strict=True)) == 1 for a, b in zip(cells, cells[1:], strict=False))


def test_shards(spark, docs):
    out = sharding.shard_rows(docs.union(docs), 7).collect()
    assert len(out) == 2 * docs.count()
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert [r["curve_index"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))] == sorted(r["curve_index"] for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (3, 4)} == {16}
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_language(spark, docs):
    rng = random.Random(2)
    kinds = {"xx": "abcdef", "yy": "uvwxyz"}
    texts = [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(2, 8))) for _ in range(30)), lang) for k in range(80) for lang in [("xx", "yy")[k % 2]]]
    net = language.train([(language.drawn(t), lang) for _, t, lang in texts[:40]], steps=60)
    assert all(p == lang for (p, _), (_, _, lang) in zip(language.pooled(net, [t for _, t, _ in texts[40:]]), texts[40:], strict=True))
    out = rows(language.identify(docs, net))
    assert [out[k]["lang_pred"] for k in (3, 4, 5, 14)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty(spark), net).count() == 0


def test_gradients_match_differences():
    import numpy as np

    net = language.BiGru(["a", "b", "c"], np.random.default_rng(0), hidden=3, embed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, filled = language.padded([b"abc", b"d", b"efghi"])
    y = np.array([0, 2, 1])
    _, g = net.gradients(x, filled, y)
    for name, at in (("Uf", (1, 2)), ("Ub", (2, 7)), ("Wf", (0, 4)), ("bb", (5,)), ("V", (3, 1)), ("E", (100, 1))):
        old, d, losses = net.p[name][at], 1e-3, []
        for step in (d, -d):
            net.p[name][at] = old + step
            losses.append(net.gradients(x, filled, y)[0])
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / (2 * d) - g[name][at]) < 2e-3, name


def test_decontamination(spark, docs, corpus):
    rng = random.Random(3)
    items = [(1, " ".join(corpus[8][1].split()[10:40])), (2, prose(rng, 30)), (3, None), (4, ""), (5, "That it."), (6, " ".join(corpus[0][1].split()[195:225]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = decontaminate.brute_force([(r[0], r[1]) for r in corpus], items)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    assert {(8, 1), (0, 6), (6, 5)} <= wanted
    assert decontaminate.find_leaks(empty(spark), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_recall_and_share():
    """Of planted passages that are similar to an item, nearly all are within the radius; few windows are looked up."""
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randint(8, 60))) for k in range(3000)]
    index, hashes = decontaminate.Benchmark([t for _, t in items]), WordHashes()
    near = found = 0
    for k, text in items:
        w = text.split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        if rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        doc = prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20)
        if decontaminate.brute_force([(0, doc)], [(k, text)]):
            near += 1
            found += any(m[0] == k for m in index.matches(hashes.of(words(doc))))
    assert near > 1000 and found >= 0.999 * near


def test_decontamination_of_a_long_contaminated_document():
    """20,000 items of one length; the document is made of 600 of them. Few pairs of a window and an item are looked at."""
    rng = random.Random(14)
    items = [prose(rng, 30) for _ in range(20_000)]
    index, hashes = decontaminate.Benchmark(items), WordHashes()
    held = rng.sample(range(20_000), 600)
    text = " ".join(items[k] for k in held)
    looked_at, one = [], index.by[30]
    one.near_pairs = lambda prints, windows, places, f=one.near_pairs: looked_at.append((len(prints), len(windows), len(set(places.tolist())))) or f(prints, windows, places)
    began = time.process_time()
    found = index.matches(hashes.of(words(text)))
    assert time.process_time() - began < 2
    assert {m[0] for m in found} >= set(held) and all(m[1] == 1.0 and m[4] == 0 for m in found if m[0] in set(held))
    (windows, pairs, places), = looked_at
    assert places < 0.05 * len(items) and pairs < 0.01 * windows * len(items)
    looked_at.clear()
    assert index.matches(hashes.of(words(prose(rng, 18_000)))) == [] and sum(x[1] for x in looked_at) == 0


def test_decontamination_tables_and_pairs_agree():
    rng = random.Random(15)
    items = [prose(rng, 30) for _ in range(300)]
    index = decontaminate.Benchmark(items).by[30]
    prints = decontaminate.fingerprints(np.stack([decontaminate.signs(s).sum(axis=0) for s in index.items[:40]]))
    every = np.repeat(np.arange(40), 300), np.tile(np.arange(300), 40)
    assert sorted(index.near(prints)) == sorted(index.near_pairs(prints, *every))
    distance = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert sorted(index.near(prints)) == sorted((w, i, d) for w in range(40) for i in range(300) if (d := distance(prints[w], index.prints[i])) <= decontaminate.RADIUS)


def test_decontamination_in_blocks(spark, corpus):
    """Ids of other types; each item in a block of its own, which writes its matches before the next is read."""
    rng = random.Random(13)
    items = [(f"i{k}", " ".join(corpus[k][1].split()[:25])) for k in (15, 16, 17, 18)] + [(None, prose(rng, 20))]
    docs = spark.createDataFrame([(f"d{r[0]}" if r[0] else None, r[1]) for r in corpus], "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("similarity", F.lit("x"))
    assert len(list(decontaminate.blocks(bench, 10))) == 5
    wanted = {(f"d{d}" if d else None, i) for d, i in decontaminate.brute_force([(r[0], r[1]) for r in corpus], items)}
    assert len(wanted) == 4
    for chars in (10, 150, 10_000):
        found = decontaminate.find_leaks(docs, bench, block_chars=chars)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted
        assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "double", "bigint", "bigint", "int"]


def test_jaccard(spark, docs, corpus):
    out = rows(jaccard.jaccard_join(docs))
    wanted = jaccard.brute_force([(r[0], r[1]) for r in corpus])
    assert {k: (r["class_id"], r["n_links"]) for k, r in out.items()} == wanted
    assert wanted[0][1] == 2
    assert jaccard.jaccard_join(empty(spark)).count() == 0


def test_jaccard_large_bucket_and_banding(spark):
    bands, n = jaccard.banding()
    assert 1 - (1 - 0.8**n) ** bands >= 0.9999
    rng = random.Random(4)
    base, texts = prose(rng, 60).split(), []
    for k in range(180):  # more than one block, and far more than SMALL
        w = list(base)
        w[rng.randrange(60)] = f"n{k}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {k: (r["class_id"], r["n_links"]) for k, r in rows(jaccard.jaccard_join(df)).items()} == jaccard.brute_force(texts)


def test_jaccard_null_and_repeated_ids(spark):
    """Texts under one id, or none, are judged like texts with ids of their own."""
    import corpus_pipeline

    rng = random.Random(7)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [a, a + " more", b, b + " more", prose(rng, 60), b]
    wanted = jaccard.brute_force(list(enumerate(texts)))
    for ids in ([None] * 6, [7] * 6, [None, None, 7, 7, 8, 7]):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS)
        hashes = {r["h"]: r["text"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        out = jaccard.jaccard_join(df).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, hashes[r["text_key"]], r["n_links"]) for r in out) == sorted((i is None, i or 0, t, wanted[k][1]) for k, (i, t) in enumerate(zip(ids, texts, strict=True)))
        stay = [r["text"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
        assert len(stay) == 3 and {t in (a, a + " more") for t in stay} == {True, False} and texts[4] in stay


def test_jaccard_bucket_of_ten_thousand(spark):
    """Near copies of one text, each with a word of its own: all are similar to all, and most share buckets."""
    rng = random.Random(11)
    base, n = [f"w{rng.randrange(10**6)}" for _ in range(120)], 10_050
    texts = []
    for k in range(n):
        w = list(base)
        w[rng.randrange(120)] = f"n{k}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = jaccard.jaccard_join(df).groupBy("class_id").agg(F.count(F.lit(1)), F.sum("n_links"), F.max("n_links")).collect()
    assert len(found) == 1 and found[0][:2] == (0, n) and found[0][3] == n - 1
    assert (1 - 1e-5) * n * (n - 1) <= found[0][2] <= n * (n - 1)  # the bands' recall at this similarity, 0.84


def test_toxicity(spark, docs):
    rng = random.Random(5)
    texts = [(k, prose(rng, 40) + (" vile wretch " if k % 4 == 0 else " ") + prose(rng, 40), None, None, 0) for k in range(400)]
    df = spark.createDataFrame(texts, DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    out = toxicity.score(df, labels).join(labels, "doc_id").collect()
    assert sum((r["score"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in out) > 390
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, labels).collect())
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(empty(spark), labels).count() == 0


def substring_brute_force(corpus):
    seen, out = {}, {}
    w = {r[0]: words(r[1]) for r in corpus}
    for k in sorted(w):
        for i in range(len(w[k]) - 19):
            seen.setdefault(tuple(w[k][i : i + 20]), (k, i))
    for k, v in w.items():
        gone = {i + j for i in range(len(v) - 19) if seen[tuple(v[i : i + 20])] < (k, i) for j in range(20)}
        out[k] = (len(v), len(gone), b" ".join(x for i, x in enumerate(v) if i not in gone).decode())
    return out


def test_substrings(spark, docs, corpus):
    out = rows(substrings.dedup_substrings(docs))
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in out.items()} == substring_brute_force(corpus)
    assert out[1]["n_removed"] == 400 and out[9]["n_removed"] == 30
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_substrings_repeated_rows_and_null_ids(spark, docs, corpus):
    twice = rows(substrings.dedup_substrings(docs.union(docs)))
    assert twice[0]["n_removed"] == 0
    nulls = spark.createDataFrame([(None, corpus[0][1]), (5, corpus[0][1])], "doc_id long, text string")
    assert {k: r["n_removed"] for k, r in rows(substrings.dedup_substrings(nulls)).items()} == {None: 0, 5: 400}


LICENSED = [
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.\nCC BY, cc-by 4.0; all Rights RESERVED!",
    "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person obtaining a copy",
    "accc by bycc by, general public licenses, general public license",
    "Released under the MIT License. MIT license. https://opensource.org/licenses/MIT",
]


def test_licenses(spark, docs, corpus):
    texts = {r[0]: r[1] for r in corpus} | {100 + k: t for k, t in enumerate(LICENSED)}
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate(LICENSED)], "doc_id long, text string, score int"))
    out = rows(licenses.scan(df))
    assert {k: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for k, r in out.items()} == {k: licenses.brute_force(t) for k, t in texts.items()}
    assert out[100]["labels"] == "apache-2.0,reserved" and out[101]["base_labels"] == "cc-by,gpl,reserved"
    assert len(licenses.RULES) > 300
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_without_a_common_word(spark):
    """Each text is found by one rule's own keyword alone."""
    wanted = {
        "released under the GNU GPL v3": "gpl-3.0", "BSD 3-Clause": "bsd-3-clause", "MIT No Attribution": "mit-0", "https://www.mozilla.org/mpl/2.0": "mpl-2.0",
        "https://www.eclipse.org/legal/epl-2.0": "epl-2.0", "https://scripts.sil.org/ofl": "ofl-1.1", "this program is free software; you can redistribute it and/or modify": "gpl",
        "permission to use, copy, modify, and distribute this software for any purpose": "isc", 'provided "as is"': "as-is", "no warranties, express or implied": "no-warranty",
        "non-commercial use only": "commercial", "may not be redistributed": "no-redistribution", "may not be copied": "no-redistribution", "limit of accidents in discs 2.0": "",
    }
    out = rows(licenses.scan(spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")))
    assert [out[k]["labels"] for k in range(len(wanted))] == list(wanted.values())
    assert [licenses.brute_force(t)[5] for t in wanted] == list(wanted.values())


def spelled(tree, rng):
    """A text that a parsed expression matches, whichever a generator draws; assertions of place are left out."""
    out = ""
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                out += chr(value)
            case "ANY" | "NOT_LITERAL":
                out += rng.choice("xyz")
            case "IN":
                if str(value[0][0]) == "NEGATE":
                    out += rng.choice("xyz")
                    continue
                choice = rng.choice(value)
                out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(rng.randint(*v)), "CATEGORY": lambda v: {"DIGIT": "7", "WORD": "w", "SPACE": " "}.get(str(v).rsplit("_", 1)[-1], "q") if "NOT" not in str(v) else "q"}[str(choice[0])](choice[1])
            case "BRANCH":
                out += spelled(rng.choice(value[1]), rng)
            case "SUBPATTERN":
                out += spelled(value[3], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(spelled(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
    return out


def test_every_match_of_a_rule_holds_its_keyword():
    import re

    rng = random.Random(21)
    for level, label, keyword, regex in licenses.RULES:
        assert level in (1, 2, 3) and keyword == keyword.lower() and label == label.lower()
        texts = [spelled(re._parser.parse(regex), rng) for _ in range(60)]
        assert all(keyword in t for t in texts), (label, keyword, next(t for t in texts if keyword not in t))
        assert sum(bool(re.search(regex, t, re.ASCII)) for t in texts) > 30, (label, regex)


def test_licenses_of_many_rules_in_one_text(spark):
    """Texts made of what rules match, with crossing and nested hits, against all rules without their keywords."""
    import re

    rng = random.Random(22)
    texts = ["".join(spelled(re._parser.parse(rng.choice(licenses.RULES)[3]), rng) + rng.choice((" ", ". ", ", and ", "\n", "")) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    out = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for k, r in out.items()} == {k: licenses.brute_force(t) for k, t in enumerate(texts)}


def test_licenses_make_only_ascii_small(spark):
    texts = ["\u212aind, CC BY \u0130", "ALL RIGHTS RESERVED\u0130", "\u00c4CC BY", "CC\u212aBY", None]
    out = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for k, r in out.items()} == {k: licenses.brute_force(t) for k, t in enumerate(texts)}
    assert out[0]["n_base"] == 1 and out[2]["n_base"] == 0


def test_licenses_of_an_archive_as_one_text(spark):
    """More hits than one run of a scan; equal, nested and crossing intervals."""
    text = "Licensed under the MIT License. CC BY! gnu general public license, version 2.0 or the general public license " * 300
    out = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    short = licenses.brute_force(text[: len(text) // 100])
    assert [tuple(r[c] for c in ("n_words", "n_base", "labels")) for r in out] == [(short[0] * 100, short[1] * 100, short[5])] * 2


def test_bpe(spark, docs, corpus):
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    extra = ["a" * 2100, "  two  blanks \n\n x ", "\x1c mixed blanks ", "don't we'll 123abc é😀"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r[0]: r[1] for r in corpus} | {100 + k: t for k, t in enumerate(extra)}
    out = rows(bpe.encode_texts(df, path, tokenizers.PATTERN).withColumns({"i": F.sha2("ids", 256), "d": F.sha2("decoded", 256)}))
    wanted = dict(zip(texts, bpe.brute_force(list(texts.values()), path, tokenizers.PATTERN), strict=True))
    assert {k: (r["n_tokens"], r["i"], r["d"]) for k, r in out.items()} == wanted
    assert bpe.encode_texts(empty(spark), path, tokenizers.PATTERN).count() == 0


def test_quality(spark, docs):
    assert quality.statistics_of("a b c d e f g h\nx # y\nx # y\n\n a b c d e f g h", WordHashes()) == (22, 22, 2, 1, 16)
    out = rows(quality.judge(docs))
    assert out[3]["base_failed"] and out[4]["base_failed"] and out[10]["base_failed"] and not out[3]["kept"]
    assert out[0]["kept"]
    rng = random.Random(6)
    texts = [(k, prose(rng, rng.randint(60, 300)), "en", "s", 0) for k in range(300)] + [(1000, "### $$$ word " * 3 + " ".join(f"#{k}$ &{k}%" for k in range(60)), "en", "s", 0)]
    judged = rows(quality.judge(spark.createDataFrame(texts, DOCS)))
    assert not judged[1000]["kept"] and not judged[1000]["base_failed"]
    assert all(r["kept"] for k, r in judged.items() if k < 1000)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_of_small_groups(spark):
    """Rows of languages with few documents are judged with all others."""
    rng = random.Random(9)
    junk = "### $$$ word " * 3 + " ".join(f"#{k}$ &{k}%" for k in range(60))
    texts = [(k, prose(rng, rng.randint(60, 300)), f"l{k % 40}", "s", 0) for k in range(120)] + [(1000, junk, "rare", "s", 0)]
    for more in (0, 250):  # all rows; then a large group beside the small ones
        judged = rows(quality.judge(spark.createDataFrame(texts + [(2000 + k, prose(rng, 100), "en", "s", 0) for k in range(more)], DOCS)))
        assert all(r["distance2"] is not None for r in judged.values())
        assert not judged[1000]["kept"] and not judged[1000]["base_failed"]
        assert sum(not r["kept"] for r in judged.values()) == 1
    assert [r["distance2"] for r in quality.judge(spark.createDataFrame(texts[:1], DOCS)).collect()] == [0]


def test_mcd_finds_the_subset_of_least_determinant(spark):
    """All subsets of the share H, tried one by one."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(14)
    x = np.concatenate([rng.standard_normal((11, 5)), rng.standard_normal((3, 5)) * 0.1 + 9])
    names = list(quality.DIMENSIONS)
    rows_ = [("c", "p", None, *map(float, v)) for v in x] + [("d", "p", None, *map(float, v)) for v in x[:11]]
    df = spark.createDataFrame(rows_, "group string, pool string, every string, " + ", ".join(f"{n} double" for n in names))
    found = quality.mcd(df, ["c", "d", "p"])
    upper = np.triu_indices(5)
    estimate = lambda s: quality.covariance(s.mean(axis=0), (s.T @ s / len(s))[upper])
    best = min((np.linalg.slogdet(estimate(x[list(s)]))[1], s) for s in combinations(range(14), 11))
    assert found.logdets[0] == pytest.approx(best[0], abs=1e-6)
    assert found.means[0].tolist() == pytest.approx(x[list(best[1])].mean(axis=0).tolist())
    assert set(best[1]) == set(range(11)) and found.logdets.shape == (3,)


def test_quality_in_parts(spark):
    """More languages and more groups than are dealt with at once: the same distances."""
    rng = random.Random(17)
    texts = [(k, prose(rng, rng.randint(20, 200)), f"l{k % 3}", f"s{k % 4}", 0) for k in range(150)] + [(1000, "### $$$ word " * 30, None, None, 0)]
    df = spark.createDataFrame(texts, DOCS)
    old = quality.CELLS, quality.STEPS
    quality.STEPS = 3
    try:
        whole = rows(quality.judge(df))
        quality.CELLS = 3
        parts = rows(quality.judge(df))
    finally:
        quality.CELLS, quality.STEPS = old
    assert {k: r["distance2"] for k, r in parts.items()} == pytest.approx({k: r["distance2"] for k, r in whole.items()})
    assert len(parts) == 151


def test_quality_base_columns(spark, corpus):
    """Against counts by plain loops."""
    import re

    blank = r"[\x20\x09-\x0D]"
    texts = [r[1] for r in corpus] + ["a b\n\n a b\n \na b\x0ba b\n%%|", "x y z w v u t s " * 3 + "é ü"]
    got = rows(quality.judge(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)))
    for k, t in enumerate(texts):
        w = [x for x in re.split(blank + "+", t or "") if x]
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for line in lines:
            if re.sub(blank, "", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {i + j for i, v in enumerate(windows) if windows.count(v) > 1 for j in range(8)}
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again)), k
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))


SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = language.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.99 * len(out)
    assert not language.lettered("½ ² Ⅷ 12_") and language.lettered("1ß")


@pytest.mark.parametrize("size", [1, 16, 255, 256, 257, 480, 481, 1000, 5000])
def test_language_windows_count_each_position_once(size):
    counted = []
    for start, stop, first, last in language.windows(size):
        assert 0 <= start <= first < last <= stop <= size and stop - start <= language.WINDOW
        assert (first - start >= language.MARGIN or start == first == 0) and (stop - last >= language.MARGIN or last == size)
        counted += range(first, last)
    assert counted == list(range(size))


def test_language_labels_every_position():
    """Windows that overlap say nearly what one window over the whole text says; blanks, digits and stops count."""
    rng = np.random.default_rng(3)
    net = language.BiGru(["a", "b", "c"], rng)
    text = prose(random.Random(4), 120) + " 12, 3.5! " + prose(random.Random(5), 60)
    data = language.small_bytes(text)
    x, filled = language.padded([data])
    run = np.concatenate([net._run(way, x, filled)[0] for way in "fb"], axis=2) @ net.p["V"] + net.p["c"]
    assert np.allclose(net.log_probabilities(x, filled)[:, :, 0], (run - np.log(np.exp(run).sum(axis=2, keepdims=True)))[:, 0], atol=1e-4)
    whole = net.log_probabilities(x, filled)[:, :, 0].mean(axis=0)
    p = np.exp(whole - whole.max())
    ((lang, score),) = language.pooled(net, [text])
    assert lang == net.languages[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-2)
    # The state runs on through blanks: what a word's positions say depends on the word before it.
    one, two = (net.log_probabilities(*language.padded([w]))[-4:, :, 0] for w in (b"xx xxmora", b"le zumora"))
    assert np.abs(one - two).max() > 1e-6
    several = [text, None, "", "12 34", "é", text[:100]] * 5
    for (lang, score), t in zip(language.pooled(net, several), several, strict=True):
        alone = language.pooled(net, [t])[0]
        assert lang == alone[0] and score == pytest.approx(alone[1], abs=1e-5)


def test_toxicity_held_out(spark):
    out = toxicity.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r["score"] for r in out if r["toxic"]], [r["score"] for r in out if not r["toxic"]]
    assert sum(b > g for b in bad for g in good) >= 0.8 * len(bad) * len(good)


def test_repeated_rows_extra_columns_and_very_long_texts(spark, docs):
    """Each row has its own result, equal for equal rows; a text of a megabyte is read whole."""
    import public_tokenizers as tokenizers

    rng = random.Random(15)
    texts = [(1, prose(rng, 150_000), "en", "s", 0), (2, "letter " * 30, "en", "s", 0), (2, "letter " * 30, "en", "s", 0), (None, None, None, None, None), (None, "", None, None, None), (None, "漢字かな" * 20_000, "ja", "s", 0)]
    df = spark.createDataFrame(texts, DOCS).withColumns({c: F.lit(1) for c in ("id", "key", "k", "e", "p", "h", "m", "toxic", "packed", "first", "cell", "mean", "size", "keep_0")})
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 0, "y")], "doc_id long, toxic int, text string")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for made in (language.identify(df), toxicity.score(df, labels), substrings.dedup_substrings(df, ("doc_id", "key", "packed")), licenses.scan(df.where("doc_id is null or doc_id = 2")), bpe.encode_texts(df, path, tokenizers.PATTERN, keep=("doc_id", "e")), quality.judge(df), sharding.shard_rows(df, 3).drop("slot", "shard"), jaccard.jaccard_join(df), decontaminate.find_leaks(df, labels.withColumn("item_id", F.col("doc_id")))):
        out = made.collect()
        twice = [tuple(map(str, r)) for r in out if r["doc_id"] == 2]
        assert len(set(twice)) <= 1 and (not twice or len(twice) == 2)
        if "similarity" not in made.columns and "hits" not in made.columns:
            assert len(out) == 6
    assert [r["n_words"] for r in substrings.dedup_substrings(df).where("doc_id = 1").collect()] == [150_000]


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    spark.createDataFrame(corpus, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(corpus[20][1].split()))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = rows(corpus_pipeline.run(spark, str(tmp_path)))
    first = [k for k, (c, _) in jaccard.brute_force([(r[0], r[1]) for r in corpus]).items() if k == c]
    wanted = set(first) - {3, 4, 5, 14, 20}
    assert set(out) == wanted
    assert all(r["n_tokens"] >= 0 and r["ids_sha256"] for r in out.values())


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    leak, clean = prose(rng, 40), [prose(rng, 40) for _ in range(3)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ((None, leak), (None, clean[0]), (5, leak), (5, clean[1]), (6, clean[2]))], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.decontaminated(spark, df, str(tmp_path)).collect()) == sorted(clean)
    assert corpus_pipeline.language_id(spark, df, "").count() == 5
    bare = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "a word")], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) AS lang", "'s' AS source", "0L AS n_chars")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, bare, "").collect()] == [4]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table; then null ids and columns, repeated rows, a very long text, columns of other names."""
    import corpus_pipeline

    rng = random.Random(16)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    a, long = prose(rng, 40), prose(rng, 60_000)
    texts = [(None, a, None, None, None), (None, a, None, None, None), (3, a, "en", "s", 1), (4, long, "en", "s", 1), (5, "", "en", "s", 1), (5, None, "en", "s", 1), (6, "short words", "de", None, None), (None, "other words", "de", "s", 2)]
    df = spark.createDataFrame(texts, DOCS).withColumns({c: F.lit(1) for c in ("id", "key", "text_key", "packed", "p")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == list(corpus_pipeline.COLUMNS)
    df = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()) == [(False, 4), (False, 6), (True, 0), (True, 0)]
