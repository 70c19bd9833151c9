"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import os
import random
import re
import struct
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyspark
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from quire.llm import chat_repair, components, decontaminate, exact_dedup, jump_shard, license_fuzzy, ngram_join, piece_codec, quality_gbdt, secret_scan, shared, warc_zdict
from quire.llm.queries import MODEL

DOCS = "doc_id long, text string, lang string, keep_id long"


def frame(spark, texts, ids=None):
    """Documents with a column whose name clashes with one of a result's."""
    return spark.createDataFrame([(i, t, "en", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def edge_texts():
    return [None, "", " \t\n", "a", "A  b\nc", "A b c", "é🙂" * 3, "word " * 30_000, "x" * 50_000]


def brute_cost(roles):
    """The least cost over all repairs, as a search over legal turns."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # start, system, user, assistant
    names = ("system", "user", "assistant")
    best = {0: 0}
    for role in roles:
        after = {}
        for s, c in best.items():
            for new in (1, 2, 3):
                base = 0 if role == names[new - 1] else 3
                for path in ((), *((m,) for m in (1, 2, 3)), *itertools.product((1, 2, 3), repeat=2)):
                    chain = (s, *path, new)
                    if all(b in legal[a] for a, b in itertools.pairwise(chain)):
                        after[new] = min(after.get(new, 1 << 30), c + base + len(path) * 2)
                if new == s:
                    after[new] = min(after.get(new, 1 << 30), c + base + 1)
        best = after
    return min(c + 2 * {0: 0, 1: 2, 2: 1, 3: 0}[s] for s, c in best.items())


def test_chat_repair_is_cheapest():
    """Every sequence of roles up to five, against a search over all repairs."""
    for n in range(1, 6):
        for roles in itertools.product(("system", "user", "assistant", "bot"), repeat=n):
            costs = chat_repair.forward(chat_repair.ENTRY0, list(roles))
            end = chat_repair.last_state(costs[-1])
            steps = chat_repair.repair(list(roles), chat_repair.ENTRY0, end)
            total = sum(s[-1] for s in steps) + chat_repair.INSERT * len(chat_repair.ending(end))
            assert total == brute_cost(roles), roles


def test_chat_blocks_do_not_matter(spark):
    """Whole conversations in numpy, and any cut into blocks, give the same rows; rendered texts are legal."""
    random.seed(2)
    sizes = {1: 40, 2: 7, 3: 1, 4: 40, None: 40, **{k: k % 6 + 1 for k in range(10, 60)}}
    rows = [(c, t, random.choice(["system", "user", "assistant", None, "tool"]), random.choice(["hi", "", None, "x\ny"])) for c, n in sizes.items() for t in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = [chat_repair.format_chats(df, block=k, longest=n).collect() for k, n in ((3, 0), (4096, 10), (5, 4096))]
    a, b, c = (sorted(str(tuple(r)[:2] + tuple(r)[3:]) for r in m) for m in made)
    assert a == b == c and len(a) == len(rows)
    whole = {}
    for r in sorted(made[2], key=lambda r: r.position):
        whole.setdefault(r.conv_id, []).append(r)
    for conv, turns in whole.items():
        said = "".join(r.piece for r in turns)
        parts = re.findall(r"<\|(system|user|assistant)\|>\n((?:(?!<\|).)*)<\|end\|>\n", said, re.S)
        assert "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in parts) == said
        roles = [role for role, _ in parts]
        start = 1 if roles[0] == "system" else 0
        assert roles[start:] == ["user", "assistant"] * ((len(roles) - start) // 2) and len(roles) == sum(r.opens for r in turns)
        given = [r for r in rows if r[0] == conv]
        assert re.sub(r"\n|<\|\w+\|>", "", said) == "".join((t or "").replace("\n", "") for *_, t in sorted(given, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")))
        assert sum(r.cost for r in turns) == brute_cost([r.role for r in turns])
    assert chat_repair.format_chats(df.limit(0)).count() == 0
    named = chat_repair.format_chats(df.selectExpr("concat('c', conv_id) AS conv_id", "turn", "role", "text", "1 AS block", "2 AS piece"), block=3, longest=2)
    assert sorted(str((r.conv_id and int(r.conv_id[1:]), *tuple(r)[1:2], *tuple(r)[3:])) for r in named.collect()) == a


def test_jump_moves_only_to_the_new_shard(spark):
    keys = np.arange(-500, 5000, dtype=np.int64).view(np.uint64)
    a, b = jump_shard.jump(keys, 8), jump_shard.jump(keys, 9)
    assert set(a) == set(range(8)) and all((a == b) | (b == 8)) and 0.07 < (b == 8).mean() < 0.16
    got = jump_shard.assign(frame(spark, edge_texts(), [None, 1, 1, 3, 4, 5, 6, 7, 8]), 3).collect()
    assert len(got) == 9 and [r.text_crc32 for r in got if r.size == 1] == [0, 0]
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_jump_shards_of_named_rows(spark):
    """Ids of letters are placed by a hash, and one shard more still takes rows only into itself."""
    docs = spark.createDataFrame([(f"d{k}", "x" * k) for k in range(300)] + [(None, None)], "doc_id string, text string")
    got = jump_shard.assign(docs, 4).collect()
    assert len(got) == 301 and {r.shard for r in got} == set(range(4)) and all(r.grown_shard in (r.shard, 4) for r in got)
    again = {r.doc_id: r.shard for r in jump_shard.assign(docs, 5).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in got)


def brute_components(texts, width, percent):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingle(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(texts)), 2):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low = min(label[i], label[j])
                label = [low if x in (label[i], label[j]) else x for x in label]
                changed = True
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, width, percent):
    random.seed(width)
    vocab = [f"w{i}" for i in range(60)]
    base = [[random.choice(vocab) for _ in range(n)] for n in (2, 5, 30, 90, 150)]
    texts = edge_texts()[:7]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(random.randint(0, max(1, len(c) // 40))):
                c[random.randrange(len(c))] = random.choice(vocab)
            texts.append(" ".join(c).upper() if random.random() < 0.3 else "\n".join(c))
    got = ngram_join.report(frame(spark, texts), width, percent)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, width, percent)
    assert ngram_join.report(frame(spark, []), width, percent).count() == 0


@pytest.mark.parametrize("light", [0, 3])
def test_ngram_join_of_crowded_keys(spark, monkeypatch, light):
    """Families of near copies that mostly aren't linked: no link is lost where keys are dealt again."""
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "DENSE", 0)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    draw = random.Random(light)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for n in (60, 100, 240):
        base = [draw.choice(vocab) for _ in range(n)]
        family = [base]
        for _ in range(24):
            c = list(draw.choice(family))
            for _ in range(draw.randint(1, max(2, n // 25))):
                at = draw.randrange(len(c))
                what = draw.random()
                c[at : at + 1] = [] if what < 0.3 else [draw.choice(vocab)] if what < 0.8 else [c[at], draw.choice(vocab)]
            family.append(c)
        texts += [" ".join(c) for c in family]
    draw.shuffle(texts)
    got = sorted(map(tuple, ngram_join.report(frame(spark, texts), 5, 80).collect()))
    want = brute_components(texts, 5, 80)
    assert got == want and 10 < len({c for *_, c in want}) < len(texts) - 10


def test_differences_keep_links():
    """Whatever the centre, two linked sets that aren't both linked to it share a key."""
    draw = np.random.default_rng(3)
    zero = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
    seen = 0
    for _ in range(3000):
        n = int(draw.integers(5, 80))
        pool = draw.integers(0, 1 << 63, 4 * n).astype(np.uint64)
        base = pool[:n]

        def vary(s, most):
            k = int(draw.integers(0, most + 1))
            kept = draw.permutation(s)[k:]
            return np.unique(np.concatenate((kept, draw.choice(pool, int(draw.integers(0, most + 1))))))

        c, x = vary(base, n // 5), vary(base, n // 4)
        y = vary(x, n // 8)
        both, linked = len(np.intersect1d(x, y)), lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        if not linked(x, y) or np.array_equal(x, y) or np.array_equal(x, c) or np.array_equal(y, c) or (linked(x, c) and linked(y, c)):
            continue
        (kx, sx), (ky, sy) = (ngram_join.differing(s, c, 5, zero, 80) for s in (x, y))
        ok = {(int(k), int(p)) for k, p in zip(kx, sx)}
        assert any((int(k), q) in ok if q == 0 else (int(k), 3 - q) in ok for k, q in zip(ky, sy)), (n, both)
        seen += 1
    assert seen > 200


def test_words_of_a_thue_morse_sequence_are_told_apart(spark):
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    assert sorted(map(tuple, ngram_join.report(frame(spark, [t, other, t])).collect())) == [(0, 1, 0), (1, 1, 1), (2, 1, 0)]


def test_sets_with_one_class_are_told_apart(spark, monkeypatch):
    """Sets whose first 64 bits are equal are different classes, as their other bits say."""
    near = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("x", "a b c d"), ("y", near), ("z", "A B C D"), (None, near), ("w", near + " more")], "doc_id string, text string")
    own = ngram_join.set_keys
    monkeypatch.setattr(ngram_join, "set_keys", lambda s: (7, own(s)[1]))
    assert {tuple(r) for r in ngram_join.report(docs).collect()} == {("x", 2, "x"), ("y", 58, "w"), ("z", 2, "x"), (None, 58, "w"), ("w", 59, "w")}


def test_keep_first_and_columns(spark):
    t = " ".join(f"w{i}" for i in range(100))
    docs = frame(spark, [t, t + " x", "other words here", t, t], [3, 1, 2, 3, 3])
    left = ngram_join.keep_first(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    # null ids sort last, repeated ids and rows leave one row a component, and names may clash
    rows = [(None, t, 1), (None, t + " y", 2), (5, "one two three four five six", 3), (5, "ONE two three four five six", 4), (5, "one two three four five six", 5), (None, None, 6), (7, t + " z", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, own_key int")
    left = ngram_join.keep_first(odd)
    assert left.columns == odd.columns and sorted((str(r.doc_id), (r.text or "")[:3].lower()) for r in left.collect()) == [("5", "one"), ("7", "w0 "), ("None", "")]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.label for r in components.label(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def brute_base(t):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(spark):
    draw = random.Random(5)
    key = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [*edge_texts(), 'é🙂 token = "abcdef12" secret:token : abcdefgh', "AKIA" + "B7" * 8 + " AKIAX " + "0a" * 15, f"see {key} and common_configuration_value_name", "password:short API-key=no apikey==abcdefg" * 3, "secret=" + "a1" * 20]
    got = {r.doc_id: r for r in secret_scan.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("markov")] == [s for s in want.split(",") if s]
    # identifiers are learned from a corpus, which the few texts here are not
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(secret_scan.random_samples(spark).unionByName(secret_scan.identifier_samples(corpus)))
    found = {r.doc_id: r.w for r in secret_scan.spans(frame(spark, texts), model).select("doc_id", secret_scan.written(F.col("spans")).alias("w")).collect()}
    assert found[11] == "markov:4:44"
    assert secret_scan.report(frame(spark, [])).count() == 0


def test_secrets_of_letters_and_short(spark):
    """Random strings without digits and keys of 16 characters are found; names, rules and numbers are not."""
    draw = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(draw.choice(a) for _ in range(n)) for a in (letters, letters + "0123456789") for n in (16, 17, 19, 20, 32) for _ in range(20)]
    names = ["MAX_RETRY_COUNT_VALUE", "state-of-the-art-technology", "mother-in-law-like", "getUserAccountDetails", "path/to/some/file", "IMG_20240115_101530", "-" * 30, "=" * 20, "_" * 16, "x" * 40, "4183418637171908", "2024-01-15-2024-01-16"]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.train(secret_scan.random_samples(spark).unionByName(secret_scan.identifier_samples(corpus)))
    texts = [f"see {k} there" for k in keys + names]
    found = {r.doc_id: r.w for r in secret_scan.spans(frame(spark, texts), model).select("doc_id", secret_scan.written(F.col("spans")).alias("w")).collect()}
    missed = [k for i, k in enumerate(keys) if found[i] != f"markov:4:{4 + len(k)}"]
    assert len(missed) <= 2, missed
    assert not [k for i, k in enumerate(names, len(keys)) if found[i]]


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(14))), (2, "Short item"), (3, None), (4, "")], "item_id long, text string")
    hit = "x B3 b4, b5-b6 b7 b8 b9 b10 b11 b12 y"
    texts = [*edge_texts(), hit, "a short ITEM short item", "b0 b1 b2 b3 b4 b5 b6 b7 b8 no"]
    got = {r.doc_id: r for r in decontaminate.report(frame(spark, texts), bench).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in (9, 10, 11)] == [(10, 1), (4, 1), (0, 0)]
    assert not any(got[i].contaminated for i in range(9)) and got[0].n_words == 0
    docs = frame(spark, texts)
    assert sorted(r.doc_id for r in decontaminate.remove(docs, bench).collect()) == [*range(9), 11]
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, "spans").collect()}
    assert re.findall(r"\w+", cut[9]) == ["x", "y"] and cut[11] == texts[11]


def test_decontaminate_by_shuffle_and_clashing_columns(spark):
    """A benchmark too large to broadcast gives the same rows; columns of any name are kept."""
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(14))), (2, "Short item"), (3, None), (3, "a c")], "item_id long, text string")
    texts = [*edge_texts(), "x B3 b4, b5-b6 b7 b8 b9 b10 b11 b12 y", "a short ITEM short item", "b0 b1 b2", "a b a c"]
    a, b = (sorted(map(str, decontaminate.scan(frame(spark, texts), bench, max_broadcast_bytes=k).collect())) for k in (1 << 20, 0))
    assert a == b
    odd = frame(spark, texts).selectExpr("doc_id", "text", "1 AS spans", "2 AS _own", "3 AS _w", "4 AS _g", "5 AS _id", "6 AS _k", "7 AS own_key", "8 AS its_id")
    for what in ("spans", "documents"):
        left = decontaminate.remove(odd, bench, what)
        assert left.columns == odd.columns and {tuple(r)[2:] for r in left.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}


def test_piece_codec(spark):
    random.seed(3)
    texts = ["".join(random.choice(" \n\tabehl▁é中🙂<s>0x0A.") for _ in range(random.randint(0, 60))) for _ in range(500)]
    data = open(MODEL, "rb").read()
    assert all(piece_codec.parity(data, texts))
    codec = piece_codec.Codec(data)
    ids = codec.encode(texts)
    assert ids == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert codec.decode(ids) == codec.tokenizer.decode_batch(ids, skip_special_tokens=False)
    got = piece_codec.digest(frame(spark, edge_texts()), MODEL).collect()
    assert all(r.parity and r.round_trip for r in got) and got[0].n_tokens == 0


def message(number, value):
    """A field of a protobuf message."""

    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("kind", [piece_codec.UNIGRAM, piece_codec.BPE])
def test_piece_codec_of_made_models(kind):
    """Models of both kinds with and without byte fallback, character map, prefix, spaces, user pieces and
    pieces across words, against the processor; of unigram splits with equal scores it may take another."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(piece_codec._fields(dict(piece_codec._fields(proto))[3]))[2]
    draw = random.Random(0)
    alphabet = ["a", "b", "c", "d", "e", " ", "  ", "é", "中", "🙂", "x", "ﬁ", "Ａ", "\t", "\n", "<usr>", "▁"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(200)]
    for fallback, mapped, dummy, fewer, cross, user in itertools.product((True, False), repeat=6):
        made = {"▁": -3.0} | {c: -4.0 - draw.random() for c in "abcdeé中"}
        for _ in range(80):
            w = "".join(draw.choice("abcde") for _ in range(draw.randint(2, 5)))
            made[("▁" if draw.random() < 0.4 else "") + w + ("▁a" if cross and draw.random() < 0.2 else "")] = -2.0 - 8 * draw.random()
        rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256 * fallback)), *[("<usr>", 0.0, 4)] * user, *((p, score, 1) for p, score in made.items())]
        trainer = message(3, kind) + message(35, int(fallback)) + message(40, 0) + message(41, 1) + message(42, 2) + message(30, "<usr>") * user
        normal = message(1, "x") + message(2, charsmap) * mapped + message(3, int(dummy)) + message(4, int(fewer)) + message(5, 1)
        model = b"".join(message(1, message(1, p) + message(2, score) + message(3, t)) for p, score, t in rows) + message(2, trainer) + message(3, normal)
        unlike = [t for t, same in zip(texts, piece_codec.parity(model, texts), strict=True) if not same]
        assert len(unlike) <= (2 if kind == piece_codec.UNIGRAM else 0), (fallback, mapped, dummy, fewer, cross, user, unlike[:3])


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u1", "same"), (5, "u5", "same"), (3, None, None), (4, "u4", ""), (9, "u\n9", "é" * 70_000), (5, "u5", "same"), (None, "n", "same")], "page_id long, url string, html string")
    got = sorted(map(tuple, warc_zdict.round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    want = [(1, 4, "revisit", 5), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 4, "response", None), (5, 4, "response", None), (9, 140_000, "response", None), (None, 4, "revisit", 5)]
    assert got == sorted(want, key=str)
    shuffled = warc_zdict.plan_records(pages, max_broadcast_rows=0).select("page_id", "revisit", "refers_to").collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, warc_zdict.plan_records(pages).select("page_id", "revisit", "refers_to").collect()))
    assert warc_zdict.round_trip(pages.limit(0)).count() == 0


def test_warc_archives_on_disk(spark, tmp_path):
    """The dictionary is in a leading skippable frame, each record is a frame of its own, and any can be read
    by its offset; the same pages make the same files."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>page {k} of many alike</p>" * (k % 5 + 1)) for k in range(200)], "page_id long, url string, html string").coalesce(1)
    files = [warc_zdict.write(pages, str(tmp_path / d)).collect() for d in ("a", "b")]
    assert sum(r.records for r in files[0]) == 200
    (name,) = [r.file for r in files[0]]
    data = (tmp_path / "a" / name).read_bytes()
    assert data == (tmp_path / "b" / name).read_bytes()
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < n <= warc_zdict.DICT_BYTES
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    at, heads = 8 + n, []
    while at < len(data):
        one = unpack.decompressobj()
        record = one.decompress(data[at:])
        assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC/1.1") == 1
        heads.append(at)
        at = len(data) - len(one.unused_data)
    assert len(heads) == 200 and at == len(data)
    assert b"page 7 of" in unpack.decompressobj().decompress(data[heads[7] :])


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_gbdt.report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.97
    some = quality_gbdt.report(frame(spark, edge_texts()), labels.limit(0)).collect()
    assert {r.score for r in some} == {0.5}


def test_quality_filter_keeps_columns(spark):
    docs = spark.createDataFrame([("a", "Some words that stand here.", 1, 2), ("b", None, 3, 4), ("c", "!!! $$$ ### x", 5, 6)], "doc_id string, text string, score int, _y int")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "doc_id string, quality int")
    assert sorted(r.doc_id for r in quality_gbdt.report(docs, labels).collect()) == ["a", "b", "c"]
    left = quality_gbdt.filter_good(docs, labels, threshold=0.0)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(map(tuple, docs.collect()))
    assert quality_gbdt.filter_good(docs, labels, threshold=1.1).count() == 0


def test_licenses(spark):
    texts = [*edge_texts(), "GNU General Public License; gnu general public license", "Relesed under the MIT Licence.", "cc by, CC-BY", "mit"]
    got = {r.doc_id: r for r in license_fuzzy.scan(frame(spark, texts)).collect()}
    assert (got[9].n_base, got[9].first_word, got[9].last_word, got[9].base_labels) == (2, 0, 4, "gpl")
    assert (got[10].n_base, got[10].labels, got[10].spans) == (0, "mit", "mit:0:29:2")
    assert (got[11].n_base, got[11].last_word) == (2, 2)
    assert all(got[i].n_base == 0 and got[i].score == 0 for i in (*range(9), 12))
    named = license_fuzzy.scan(spark.createDataFrame([("a", "mit license")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.n_base, r.score) for r in named] == [("a", 1, 1.0)]


def test_licenses_with_edits():
    """Any notice is found with no more edits than it may have, if none is in the words that name it."""
    draw = random.Random(4)
    search = license_fuzzy.Searcher()
    for n in license_fuzzy.NOTICES:
        harmless, at = [], 0
        for w in n.text.split():
            if w not in n.names:
                harmless += range(at, at + len(w))
            at += len(w) + 1
        for _ in range(10):
            t = list(n.text)
            for k in draw.sample(harmless, min(n.edits, len(harmless) - 2)):
                t[k] = draw.choice(["z", "", t[k] + "z"])
            got = search.spans("some words " + "".join(t) + " more words")
            assert any(s[2] == n.label for s in got), (n, "".join(t), got)
    (a, b, k, e) = search.found("licensed under the gnu general public licens")[0]
    row = license_fuzzy.scan_text("licensed under the gnu general public licens", search)
    assert e == 1 and row[6] == 1 - 1 / len(search.notices[k].text)


def test_licenses_of_other_names():
    """A licence's name isn't taken for another's."""
    search = license_fuzzy.Searcher()
    only = lambda t: {s[2] for s in search.spans(t)}
    for name, label in (("bsd", "bsd"), ("isc", "isc"), ("mit", "mit"), ("wtf", None), ("mpl", None), ("zlib", None), ("nit", None), ("apache", "apache"), ("gnu lesser general public", "lgpl"), ("gnu affero general public", "agpl"), ("gnu general public", "gpl"), ("gnu library general public", None)):
        for verb in ("released", "licensed", "relased", "distributd"):
            assert only(f"it is {verb} under the {name} license here") == ({label} if label else set()), (verb, name)
    for more in ("", "nc", "nd", "sa", "nc sa", "nc nd"):
        label = "-".join(["cc", "by", *more.split()])
        assert only(f"licensed under cc by {more} 4 0".replace("  ", " ")) == {label}
        long = " ".join(license_fuzzy._CC[k] for k in more.split())
        assert only(f"licensed under a creative commons attribution {long} 4 0 international".replace("  ", " ")) == {label}
    assert only("permission to use copy modify and distribute this software for any purpose") == {"isc"}
    assert only("this work is licensed under the gnu lesser general public license version 3") == {"lgpl"}
    assert only("all writes observed, the license of the public was general under a gnu") == set()


def test_license_base_places():
    """Base columns on random texts, against a search word by word."""
    draw = random.Random(6)
    search = license_fuzzy.Searcher()
    parts = ["GNU", "general", "Public", "license", "apache", "MIT", "cc", "BY", "é", "x1", "Kelvin", "\u212a"]
    for _ in range(400):
        t = "".join(draw.choice(parts) + draw.choice([" ", "-", "\n", "", ", "]) for _ in range(draw.randint(0, 30)))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((i, label) for p, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        want = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert license_fuzzy.scan_text(t, search)[:5] == want, t


def test_licenses_side_by_side():
    """A damaged notice doesn't disappear beside another, before or after it."""
    search = license_fuzzy.Searcher()
    labels = lambda t: [s[2] for s in search.spans(t)]
    assert search.spans("all rights reserved distribution and use in source and binary forms") == [(0, 19, "reserved", 0), (20, 67, "bsd", 2)]
    assert search.spans("released under the mit lice all rights reserved") == [(0, 27, "mit", 3), (28, 47, "reserved", 0)]
    assert labels("all rights reservedistribution and use in source and binary forms") == ["reserved", "bsd"]
    # the best match of a window is neither the first nor the last
    assert search.spans("all rghts reserved all rights reserved all rights reservd") == [(0, 18, "reserved", 1), (19, 38, "reserved", 0), (39, 57, "reserved", 1)]
    # two readings of one place are one notice
    assert search.spans("licensed under cc by nc 4 0") == [(0, 27, "cc-by-nc", 0)]
    # any two neighbours, damaged inside
    some = [n for k, n in enumerate(license_fuzzy.NOTICES) if k % 3 == 0 or not n.names]
    for x, y in itertools.permutations(some, 2):
        if not x.others & set(y.text.split()):
            t = f"some {x.text[:4]}z{x.text[5:]} {y.text[:4]}z{y.text[5:]} words"
            assert {x.label, y.label} <= set(labels(t)), t


def brute_groups(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    out = []
    for i, n in zip(ids, norm, strict=True):
        same = [k for k, m in zip(ids, norm, strict=True) if m == n]
        keep = min((k for k in same if k is not None), default=None)
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """Against plain Python; with weak keys, chains; with weak digests too, entries told by their bytes."""
    texts = [*edge_texts(), "A b c", "A\tb c", "", "A b c", *(f"text {k % 37}" for k in range(90))]
    ids = [*range(len(texts) - 2), 4, None]
    how = {"key": lambda t: F.char_length(t).cast("long") % 5, "digest": lambda t: F.substring(t, 1, 5)} if weak else {}
    got = exact_dedup.exact_groups(frame(spark, texts, ids), capacity=2, **how).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_groups(texts, ids)
    if not weak:
        assert {r.text_sha256 for r in got} == {hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest() for t in texts}
        kept = exact_dedup.keep(frame(spark, texts, ids))
        assert kept.count() == len({re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts}) and kept.columns == frame(spark, []).columns
        assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_dedup_buckets(spark):
    """Buckets split until none holds too much; each key has one, in an order of ranges."""
    draw = random.Random(8)
    keys = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + list(range(40)) + [-1, -2, 1 << 62]
    rows, index, slots = exact_dedup.build_index(spark.createDataFrame([(i, str(k)) for i, k in enumerate(keys)], "doc_id long, text string"), capacity=3, key=lambda t: t.cast("long"))
    got = {r.key: r.bucket for r in index.collect()}
    assert len(got) == len(set(keys)) == index.count()
    most = {}
    for b in got.values():
        most[b] = most.get(b, 0) + 1
    assert max(most.values()) <= 3 and slots.agg(F.max("depth")).first()[0] == 63
    unsigned = sorted(set(keys), key=lambda k: k % (1 << 64))
    assert [got[k] for k in unsigned] == sorted(got[k] for k in unsigned)
    assert sum(2.0 ** -r.depth for r in slots.collect()) == 1


def test_keep_with_clashing_columns(spark):
    rows = [(3, "a  b", 1, 2), (1, "a b", 3, 4), (1, "a\tb", 5, 6), (None, "x", 7, 8), (None, "x", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, own_key int")
    left = exact_dedup.keep(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]


def test_empty_tables_and_repeated_rows(spark):
    """No rows give no rows; rows that repeat each give their own."""
    twice = frame(spark, ["some words to scan here", "some words to scan here", None], [1, 1, 1])
    bench = spark.createDataFrame([(1, "words to")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    runs = {
        "shard": lambda d: jump_shard.assign(d, 4), "secrets": secret_scan.report, "leaks": lambda d: decontaminate.report(d, bench), "codec": lambda d: piece_codec.digest(d, MODEL),
        "quality": lambda d: quality_gbdt.report(d, labels), "licenses": license_fuzzy.scan, "dedup": exact_dedup.exact_groups,
    }
    for name, run in runs.items():
        assert run(frame(spark, [])).count() == 0, name
        got = run(twice).collect()
        assert len(got) == 3 and {r.doc_id for r in got} == {1}, name


def walk_trees(trees, x):
    """A score, one node at a time."""
    total = trees.start
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_pipeline(spark):
    """run()'s rows against the five stages in plain Python, over a whole small table."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    d = "/root/testdata/sf0.001"
    tables = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    trees = quality_gbdt.train(tables["documents"], tables["labels"])
    docs = [(r.doc_id, r.text or "") for r in tables["documents"].collect()]
    good = sorted((i, t) for i, t in docs if walk_trees(trees, quality_gbdt.statistics(t)) >= 0.7)
    first = {}
    for i, t in good:
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (i, t))
    once = sorted(first.values())
    parts = [c for _, _, c in brute_components([t for _, t in once], 5, 80)]
    apart = [x for k, x in enumerate(once) if parts[k] == k]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in tables["benchmark"].collect():
        w = words(r.text)
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    clean = [(i, t) for i, t in apart if not hit(words(t))]
    assert len(docs) > len(good) > len(once) > len(apart) > len(clean) > 20  # every stage does something
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((i, len(ids), zlib.crc32(np.asarray(ids, "<i4").tobytes()), hashlib.sha256(own.decode(ids).encode()).hexdigest(), own.decode(ids) == t, True) for i, t in clean for ids in (own.encode(t),))
    got = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity").collect())) == want


def test_a_written_step_holds_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in found.mkString("\n").split("\n") if "shuffle_" in name}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    own = spark.conf.get(key)
    out = shared.cut(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count(), "counted")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000 and spark.conf.get(key) == own


def test_tokens_of_the_same_members_go_before_keys_are_dealt_by_size(spark):
    rows = [(t, c, 40 + c, t + 1) for t in range(6) for c in (1, 2)] + [(9, c, 40 + c, 8) for c in (2, 3)]
    dealt = []
    real = ngram_join._by_size
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "_by_size", lambda met, percent: dealt.append(met.count()) or real(met, percent))
        met = ngram_join._met(spark.createDataFrame(rows, "token long, class long, n int, pos int"), 80).collect()
    assert dealt == [4]  # token 0 for 1 and 2, token 9 for 2 and 3
    of = {}
    for r in met:
        of.setdefault(r.token, set()).add((r["class"], r.pos))
    assert {(1, 1), (2, 1)} in of.values() and {(2, 8), (3, 8)} in of.values()


def tables_of(monkeypatch):
    """The rows of each table that the n-gram join writes, by name."""
    made, real = {}, shared.cut

    def cut(df, name, rows=None):
        out = real(df, name, rows)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    return made


def test_long_texts_that_share_a_passage_are_not_taken_for_near_ones(spark, monkeypatch):
    """Sets of several thousand tokens fill 2048 bits, which then tell nothing: pairs of long texts grew with their square."""
    draw = random.Random(1)
    # each passage is in two texts, and its words are rarer than the others
    texts = [" ".join([f"t{k}w{draw.randrange(400)}" for _ in range(5800)] + [f"p{k // 2}w{i}" for i in range(300)]) for k in range(4)]
    # 8190 and 8210 words: one set has twice as many bits as the other
    near = [f"n{i}" for i in range(8194)]
    texts += [" ".join(near), " ".join(near + [f"more{i}" for i in range(16)]), " ".join(near[:4000])]
    made = tables_of(monkeypatch)
    got = sorted(tuple(r) for r in ngram_join.report(frame(spark, texts), 5, 80).collect())
    assert [c for *_, c in got] == [0, 1, 2, 3, 4, 4, 6]
    assert sum(made["pairs"]) > 2 and sum(made["near"]) == 1


def test_pairs_and_tokens_in_parts_lose_no_link(spark, monkeypatch):
    draw = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [draw.choice(vocab) for _ in range(80)]
        for _ in range(6):
            c = list(base)
            for _ in range(draw.randint(0, 2)):
                c[draw.randrange(80)] = draw.choice(vocab)
            texts.append(" ".join(c))
    made = tables_of(monkeypatch)
    monkeypatch.setattr(ngram_join, "PART_LEAST", 300)
    got = sorted(tuple(r) for r in ngram_join.report(frame(spark, texts), 5, 80).collect())
    assert got == brute_components(texts, 5, 80)
    # each of the first two has all prefixes or pairs at once else
    assert 1 < len(made["shared"]) <= 4 and len(made["sets"]) > len(made["near"])


def test_words_that_come_again_outlive_the_memory_of_rarer_ones(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHED_BYTES", 40_000)
    codec, fresh = piece_codec.Codec(open(MODEL, "rb").read(), checked=True), []
    real = codec._of_words
    monkeypatch.setattr(codec, "_of_words", lambda words: fresh.extend(words) or real(words))
    for k in range(20):
        texts = [f"the same words ▁ ▁▁x {' '.join(f'w{k}x{i}ñ語' for i in range(60))}", "", " two  gaps "]
        assert all(codec.agrees(texts, codec.encode_raw(texts)))
    assert fresh.count("same") == 1 and codec.older


def test_words_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    codec, fresh = piece_codec.Codec(open(MODEL, "rb").read(), checked=True), []
    real = codec._of_words
    monkeypatch.setattr(codec, "_of_words", lambda words: fresh.extend(words) or real(words))
    words = [f"w{k}é" for k in range(120_000)]
    for _ in range(2):
        for k in range(0, len(words), 5_000):
            texts = [" ".join(words[k : k + 5_000])]
            assert codec.agrees(texts, codec.encode_raw(texts)) == [True]
    assert len(fresh) == len(words) and not codec.older


def test_words_are_kept_between_tasks_of_one_stage_only(monkeypatch):
    class Task:
        def __init__(self, stage):
            self.stageId = lambda: stage

    data, kept = open(MODEL, "rb").read(), []
    for stage in (1, 1, 2, None, None):
        monkeypatch.setattr(piece_codec.TaskContext, "get", lambda at=stage: at and Task(at))
        codec = piece_codec.codec_of(data, False)
        kept.append(len(codec.known))
        codec.encode(["two words"])
    assert kept == [0, 2, 0, 0, 0]


def test_executors_give_back_memory(tmp_path):
    """In a process of its own, as it needs an executor: memory of its JVM, without and with pages taken, and after a step."""
    code = '''
import os, re, pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from quire.llm import shared

spark = SparkSession.builder.getOrCreate()

def size(batches):
    list(batches)
    jvm = [x for x in (int(p) for p in os.listdir("/proc") if p.isdigit()) if own(x)]
    yield pa.RecordBatch.from_arrays([pa.array([max(map(mb, jvm))], pa.int64())], ["mb"])

def own(pid):
    try:
        return b"CoarseGrainedExecutorBackend" in open(f"/proc/{pid}/cmdline", "rb").read() and os.environ["MARK"].encode() in open(f"/proc/{pid}/environ", "rb").read()
    except OSError:
        return False

def mb(pid):
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open(f"/proc/{pid}/smaps_rollup").read()))) // 1024

taken = lambda: spark.range(1).coalesce(1).mapInArrow(size, "mb long").first()[0]
taken()
spark.range(0, 6_000_000, 1, 1).select(F.array(*[F.col("id") + k for k in range(8)]).alias("a"), F.rand(1).alias("r")).sortWithinPartitions("r").write.format("noop").mode("overwrite").save()
before = taken()
shared.last_only(spark, lambda: shared.cut(spark.range(10).toDF("id"), "step"))
time = __import__("time")
for _ in range(10):
    after = taken()
    if after < before - 200:
        break
    time.sleep(0.5)
print("MB", before, after)
spark.stop()
'''
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    conf = {"spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.executor.extraJavaOptions": "-XX:+UseG1GC", "spark.executorEnv.MARK": str(tmp_path)}
    args = " ".join(f"--conf {k}={v}" for k, v in conf.items())
    env = os.environ | {"MARK": str(tmp_path), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(shared.__file__).parents[2]), "PYSPARK_SUBMIT_ARGS": f"--master local-cluster[1,1,1000] {args} pyspark-shell"}
    ran = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert (found := re.search(r"^MB (\d+) (\d+)$", ran.stdout, re.M)), ran.stderr[-3000:]
    before, after = map(int, found.groups())
    assert after < before - 200
