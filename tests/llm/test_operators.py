"""Each training-data operator against a brute-force version, and on nulls, ties, repeats, empty and clashing input."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geochange.llm import bpe, chat, common, components, exact_dedup, language, line_dedup, mixing, near_copies, quality, queries, simhash, sketch, toxicity

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and columns that clash with new ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + "\n" + "x" * 20_000
    rows = [
        (1, "Hello there, World\nagain and again", "en", "a"),
        (1, "Hello there, World\nagain and again", "en", "a"),
        (2, "hello there, world\nagain and again", None, None),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \n\n ", "de", "b"),
        (None, "a null id", "fr", "a"),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, long, "en", "a"),
        (8, "ÀÉ ß İ Σ 日本\x00🙂 ", "fr", "ä"),
        (8, "another text of one id", "fr", "ä"),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], DOC)
    return df.select("*", *[F.lit(1).alias(c) for c in ("n_lines", "score", "mix_repeat", "n_tokens", "_key", "runs", "d", "fp", "id", "_norm")])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# --- exact dedup ------------------------------------------------------------------------------------------------


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, odd, keep):
    rng = random.Random(4)
    texts = ["", "same", "SAME", "Äa", "äa", "x" * 100 + "1", "x" * 100 + "2", None]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep, 7).collect()
    by = collections.defaultdict(list)
    for i, t in rows:
        by[_lower(t)].append(i)
    want = {(i, hashlib.sha256(t.encode()).hexdigest(), (min if keep == "smallest" else max)(ids), len(ids), i == (min if keep == "smallest" else max)(ids)) for t, ids in by.items() for i in ids}
    assert {tuple(r) for r in got} == want
    assert exact_dedup.exact_dedup(odd, keep).count() == odd.count()


# --- SimHash ----------------------------------------------------------------------------------------------------


def _simhash(text):
    words = [w for w in "".join(_lower(text)).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aB \t\n\x0b\x1c\xa0é", max_size=60))
@settings(deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _simhash(text)


def test_near_components(spark, odd):
    rng = np.random.default_rng(2)
    rows, word = [], lambda: "".join(rng.choice(list("abcdefgh"), 4))
    for i in range(60):
        base = [word() for _ in range(120)]
        rows.append((3 * i, " ".join(base)))
        for k in (1, 2):
            base[rng.integers(120)] = word()
            rows.append((3 * i + k, " ".join(base)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: _simhash(t) for i, t in rows}
    to = {i: i for i in fp}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, j in itertools.combinations(sorted(fp), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 4:
            a, b = sorted((root(i), root(j)))
            to[b] = a
    assert got == {i: (f"{fp[i]:016x}", root(i)) for i in fp}
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_components(odd).collect()}
    assert out[(3, "0" * 16)] == 3 and out[(4, "0" * 16)] == 3 and out[(None, "0" * 16)] == 3


def test_shards_of_any_size_join_what_pairs_join():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in np.repeat(centre, 40)], dtype=np.uint64)
    fp = np.unique(near)

    def classes(pairs):
        to = list(range(len(fp)))

        def root(i):
            while to[i] != i:
                i = to[i]
            return i

        for i, j in pairs:
            a, b = sorted((root(i), root(j)))
            to[b] = a
        return [root(i) for i in range(len(fp))]

    at = {int(x): i for i, x in enumerate(fp)}
    brute = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4) if i < j]
    u, v = simhash.shard_edges(fp, 4)
    assert classes([(at[int(a)], at[int(b)]) for a, b in zip(u, v, strict=True)]) == classes(brute)


def test_a_linked_pair_shares_a_shard():
    masks = simhash.choices(4)
    for places in itertools.islice(itertools.combinations(range(0, 64, 3), 4), 0, 4000, 7):
        d = sum(1 << p for p in places)
        assert any(d & m == 0 for m in masks)


def test_hot_rings_are_met_block_against_block(spark):
    rng = np.random.default_rng(6)
    fp = np.unique(rng.integers(0, 2**16, 900, dtype=np.int64))  # most places agree: most rings hold all
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")

    def classes(block, extra=2):
        return {r.node: r.root for r in components.components(simhash.near_links(df, 4, extra, block)).collect()}

    whole = classes(simhash.BLOCK)
    assert classes(100) == whole == classes(100, 3)
    brute = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :][np.bitwise_count(a ^ fp[i + 1 :]) <= 4]}
    assert all(whole[a] == whole[b] for a, b in brute) and len(whole) == len({x for e in brute for x in e})


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


# --- BPE --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers_pair():
    public = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers")
    path = public.path(queries.TOKENIZER)
    return bpe.Tokenizer(bpe.read_tokenizer(path)), lib.Tokenizer.from_file(path)


@given(st.text(alphabet=st.one_of(st.sampled_from("aaabcdeinstth'  \n12é²ªŉΣΑσ́\x85\x1cİßﬁ日🙂<|>"), st.characters(max_codepoint=0x2FF)), max_size=40))
@settings(deadline=None, max_examples=600)
def test_bpe_equals_the_library(tokenizers_pair, text):
    own, lib = tokenizers_pair
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [":\U0003d000", "a\u0558b ₯\u088f9", "\U00013460x\U000105c0 y", "\ufdd0\uffff!"])
def test_bpe_code_points_of_other_versions(tokenizers_pair, text):
    """Letters of newer versions of Unicode than one of the libraries knows, and what is none in any."""
    own, lib = tokenizers_pair
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_bpe_table_accepts_what_merging_makes(tokenizers_pair):
    """Pairs of tokens: an arc leads on exactly if merging the pair's symbols by rank gives the pair back."""
    import json

    own = tokenizers_pair[0].automaton
    model = json.loads(queries.tokenizer_file())["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
    vocab = [t for t in model["vocab"] if not t.endswith("</w>")]
    rng = random.Random(8)
    for _ in range(3000):
        x, y = rng.choice(vocab[:3000]), rng.choice(vocab[:3000])
        parts = list(x + y)
        while True:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1e9), default=None)
            if k is None or (parts[k], parts[k + 1]) not in rank:
                break
            pair, i, now = (parts[k], parts[k + 1]), 0, []
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    now.append(pair[0] + pair[1])
                    i += 2
                else:
                    now.append(parts[i])
                    i += 1
            parts = now
        assert own.arc(model["vocab"][x], model["vocab"][y]) == (parts == [x, y])


def test_bpe_refuses_files_of_other_rules():
    import json

    content = json.loads(queries.tokenizer_file())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"added_tokens": [content["added_tokens"][0] | {"lstrip": True}]}, {"decoder": {"type": "BPEDecoder"}}):
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(content | change))


def test_bpe_special_tokens(tokenizers_pair):
    own, lib = tokenizers_pair
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "aaaaaaaa<|"):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_bpe_documents(spark, odd, tokenizers_pair):
    own, lib = tokenizers_pair
    out = bpe.encode(odd, queries.tokenizer_file())
    assert "source_n_tokens" in out.columns and out.columns[-4:] == ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    texts = {(r.doc_id, r.n_chars): r.text for r in odd.collect()}
    for r in out.collect():
        ids = lib.encode(texts[(r.doc_id, r.n_chars)] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- line dedup -------------------------------------------------------------------------------------------------


def _brute_lines(rows, least):
    docs = sorted({(i, t) for i, t in rows if t is not None})
    seqs = {d: d[1].split("\n") for d in docs}
    # The order of documents of one id is that of a hash; these rows have one text for each id.
    places = [(d, p) for d in docs for p in range(len(seqs[d]))]
    gone = collections.defaultdict(set)
    for (d, q), (e, p) in itertools.product(places, places):
        if (e[0], p) < (d[0], q):
            a, b, n = seqs[e], seqs[d], 0
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                n += 1
            if n and sum(len(x.split()) for x in b[q : q + n]) >= least:
                gone[d].update(range(q, q + n))
    return {d[0]: "\n".join(x for k, x in enumerate(seqs[d]) if k not in gone[d]) for d in docs}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = ["one two three", "four five", "", "six", "seven eight nine ten", "x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(14)] + [(50, "\n".join(["x"] * 30)), (51, None)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == _brute_lines(rows, 5) | {51: None}


def test_suffix_ranks_are_suffix_order(spark):
    rng = random.Random(1)
    seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    rows = [(d, 0, 0, p, x, x, 1) for d, s in enumerate(seqs) for p, x in enumerate(s)]
    df = spark.createDataFrame(rows, "d long, t long, seq int, pos int, h1 long, h2 long, words int")
    for r in line_dedup.suffix_ranks(df, 3).collect():
        for k in range(4):
            own = seqs[r.d][r.pos : r.pos + 2**k]
            if len(own) < 2**k:
                assert r[f"r{k}"] is None
                continue
            smaller = sum(s[p : p + 2**k] < own for s in seqs for p in range(len(s)))
            shorter = sum(len(s[p : p + 2**k]) < 2**k and s[p : p + 2**k] == own[: len(s) - p] for s in seqs for p in range(len(s)))
            assert smaller - shorter - len(rows) <= r[f"r{k}"] <= smaller
    full = {tuple(seqs[r.d][r.pos : r.pos + 2]): r.r1 for r in line_dedup.suffix_ranks(df, 1).collect() if r.r1 is not None}
    assert [k for k, _ in sorted(full.items(), key=lambda x: x[1])] == sorted(full)


def test_line_dedup_odd(odd, empty):
    out = line_dedup.line_dedup(odd, 5)
    assert out.count() == odd.count() and "source_n_lines" in out.columns
    assert line_dedup.line_dedup(empty).count() == 0
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[6] and texts[7] == ""


# --- mixing -----------------------------------------------------------------------------------------------------


def _exponent(tokens, opts, budget):
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}

    def weights(a):
        w = {s: x**a for s, x in p.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def entropy(a):
        return -sum(x * np.log(x) for x in weights(a).values())

    def repeats(a):
        return max(x * budget / tokens[s] for s, x in weights(a).items())

    def bisect(ok):
        lo, hi = 0.0, 1.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    return max(bisect(lambda a: entropy(a) >= opts.entropy * np.log(len(p))), 0.0 if repeats(0.0) <= opts.repeats else bisect(lambda a: repeats(a) >= opts.repeats)), weights


@pytest.mark.parametrize("opts", [mixing.Mix(block=3), mixing.Mix(entropy=1.0, repeats=1.5, block=4), mixing.Mix(budget=500, block=2)])
def test_mixing(spark, opts):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaaaaaaabbbc"), " ".join(["w"] * rng.randint(1, 20))) for i in range(200)] + [(500, None, "x y z"), (501, "a", None), (502, "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = collections.Counter()
    for _, s, t in rows:
        tokens[s] += len((t or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    budget = opts.budget or sum(tokens.values())
    a, weights = _exponent(tokens, opts, budget)
    got = mixing.mix_sources(docs, opts).collect()
    by = collections.defaultdict(list)
    size = {i: len((t or "").split()) for i, _, t in rows}
    for r in got:
        by[r.source].append(r)
    for s, n in tokens.items():
        w = weights(a)[s]
        assert abs(by[s][0].mix_weight - w) < 1e-5
        quota = min(int(by[s][0].mix_weight * budget), int(n * opts.repeats))
        own = sorted(by[s], key=lambda r: r.mix_position)
        # One document after the other, with no gap, up to the quota.
        at = 0
        for r in own:
            assert r.mix_position == at
            at += size[r.doc_id]
        assert own[-1].mix_position < quota <= at
        # Each repetition is a permutation: none comes twice, and only the last may lack any.
        for k in range(own[-1].mix_repeat + 1):
            ids = [r.doc_id for r in own if r.mix_repeat == k]
            assert len(ids) == len(set(ids))
            if k < own[-1].mix_repeat:
                assert sum(size[i] for i in ids) == n


def test_mixing_odd(odd, empty):
    out = mixing.mix_sources(odd)
    assert out.columns == [*[f"source_{c}" if c == "mix_repeat" else c for c in odd.columns], "mix_repeat", "mix_weight", "mix_position"]
    assert {(r.doc_id, r.source, r._key) for r in out.collect()} <= {(r.doc_id, r.source, r._key) for r in odd.collect()}
    assert mixing.mix_sources(empty).count() == 0


# --- sketches ---------------------------------------------------------------------------------------------------


def _pieces(text):
    """The paragraphs by the definition, word by word, without the operator's expressions."""
    import regex

    out = set()
    for k, line in enumerate(text.split("\n")):
        if k and len(line) <= 128:
            out.add(line)
            continue
        words = regex.findall(r"\S+\s*", line, flags=regex.ASCII)  # of Java, whose classes are ASCII
        lead = line[: len(line) - len("".join(words))]
        out.add(lead)
        at, sizes = 0, itertools.repeat(64) if k or lead else itertools.chain((4, 8, 16, 32), itertools.repeat(64))
        while at < len(words):
            n = next(sizes)
            out.add("".join(words[at : at + n]))
            at += n
    return out - {""}


def test_short_opening_lines_share_nothing_that_they_have_not(spark):
    rows = [(2, "alpha beta gamma"), (1, "delta epsilon gamma")]
    assert [r.near_next for r in sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0.0, 0.0]


def test_retries_go_on_until_all_peel(spark):
    rows = spark.createDataFrame([(1, list(range(3000)), list(range(2000, 4500))), (2, [1], [1]), (3, [], [5])], "id long, a array<long>, b array<long>")
    got = {r.id: (r.ours, r.theirs) for r in sketch.differences(rows, "a", "b").collect()}
    assert got == {1: (2000, 1500), 2: (0, 0), 3: (0, 1)}


def test_sketches(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 90)))
    rows = [(i, "\n".join(line() for _ in range(rng.choice([1, 1, 3, 8, 120])))) for i in range(30)] + [(40, ""), (41, None), (42, "same"), (43, "same"), (44, " lead b c d e f g"), (45, "\n\n x"), (46, "a b c d"), (47, "a b c d e"), (48, " ".join(["w"] * 300))]
    got = {r.doc_id: r for r in sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = _pieces(t), _pieces(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[42].fingerprint == got[43].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in rows})


def test_sketches_odd(spark, odd, empty):
    assert sketch.fingerprint_documents(odd).count() == odd.count()
    assert sketch.fingerprint_documents(empty).count() == 0
    one = sketch.fingerprint_documents(spark.createDataFrame([(1, "only")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.near_edited < 1.0


def test_peel_recovers_the_digests(spark):
    a, b = list(range(1000, 1012)), list(range(1006, 1020))
    cells = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(sketch.sketch(F.col("a")).alias("x"), sketch.sketch(F.col("b")).alias("y"))
    p = cells.select(sketch.peel(sketch.subtract(F.col("x"), F.col("y"))).alias("p")).first().p
    assert (sorted(p.ours), sorted(p.theirs), p.left) == (list(range(1000, 1006)), list(range(1012, 1020)), 0)


# --- chats ------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="[]/INST<>s\\|Y turnedx", max_size=60))
@settings(deadline=None, max_examples=400)
def test_escaping(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)
    for role in ("system", "user", "assistant", "tool [INST]", ""):
        piece = chat.format_turn(role, text)[0]
        assert [x[:2] for x in chat.read_turns(piece * 2)] == [(role, text)] * 2


@pytest.mark.parametrize("opts", [chat.Windows(), chat.Windows(20, 8), chat.Windows(1, 0)])
def test_chats(spark, opts):
    rng = random.Random(3)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, None, None), (9, None, "assistant", "first\\"), (9, 1, "assistant", "é"), (9, 1, "assistant", "é")]
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief"))
        rows += [(c, t, "assistant" if t % 2 == 0 else "user", " ".join(["word"] * rng.randint(0, 15))) for t in range(1, rng.randint(2, 14))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_chats(df, opts, chat.tokens)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, t, role, text in sorted(rows, key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by[c].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        turns = chat.read_turns(w.formatted)
        cost = [chat.tokens(t) for _, t, _, _ in turns]
        assert sum(cost) <= opts.budget or len(turns) - w.repeated == 1
        if w.window and by[w.conv_id][0][0] == "system":
            assert turns[0][:2] == by[w.conv_id][0] and w.repeated >= 1
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def test_budgets_are_in_tokens_of_the_vocabulary(spark, tokenizers_pair):
    count = lambda t: len(tokenizers_pair[1].encode(t, add_special_tokens=False).ids)
    said = "Don't count words, count 12345 tokens!"
    rows = [(1, t, "assistant" if t % 2 else "user", said) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    n = count(said)
    assert n != chat.tokens(said)
    windows = sorted(chat.format_chats(df, chat.Windows(budget=3 * n, history=n)).collect(), key=lambda r: r.window)
    assert [(len(chat.read_turns(w.formatted)), w.repeated) for w in windows] == [(3, 0), (3, 1), (3, 1), (3, 1)]
    assert len(chat.format_chats(df, chat.Windows(budget=3 * n - 1, history=0)).collect()) == 5


def test_names_never_clash(spark):
    """A column named like a new one beside its escape name, in each operator that carries columns."""
    rows = spark.createDataFrame([(1, "some words here", "a", 5, 6, 7)], "doc_id long, text string, source string, x int, y int, z int")
    for of, new in ((line_dedup.line_dedup, "n_lines"), (mixing.mix_sources, "mix_repeat"), (lambda df: bpe.encode(df, queries.tokenizer_file()), "n_tokens")):
        (got,) = of(rows.withColumnsRenamed({"x": new, "y": f"source_{new}", "z": f"source_source_{new}"})).collect()
        assert len(got) == len(set(got.__fields__))
        assert (got[f"source_{new}"], got[f"source_source_{new}"], got[f"source_source_source_{new}"]) == (6, 7, 5)
    assert common.renamed(["a", "source_a", "b"], ["a", "c"]) == ["source_source_a", "source_a", "b"]


# --- models -----------------------------------------------------------------------------------------------------


def _auc(y, s):
    s, y = np.array(s), np.array(y)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()


def test_quality_and_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in common.table(spark, d, "labels").collect()}
    for query, name, least in ((queries.op9_quality, "quality", 0.95), (queries.op1_toxicity, "toxic", 0.8)):
        got = query(spark, d).collect()
        assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        held = [(labels[r.doc_id][name], r.score) for r in got if r.held_out and r.doc_id in labels]
        assert _auc(*zip(*held, strict=True)) > least


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in common.table(spark, d, "documents").collect()}
    got = [r for r in queries.op6_language(spark, d).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_models_odd(spark, odd, empty):
    model = language.fit_language(odd)
    out = {(r.doc_id, r.lang_pred) for r in language.identify_language(odd, model).collect()}
    assert (3, "und") in out and (4, "und") in out and (5, "und") in out
    assert language.identify_language(odd, language.fit_language(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    for y in (odd.withColumn("y", F.col("doc_id") % 2), odd.withColumn("y", F.lit(1)), empty.withColumn("y", F.lit(1))):
        q = quality.fit_quality(y, "y")
        assert quality.score_quality(odd, q).count() == odd.count() and quality.filter_quality(odd, q, 0.0).count() == odd.count()
        t = toxicity.fit_toxicity(y, "y")
        assert toxicity.score_toxicity(odd, t).count() == odd.count()
    assert quality.score_quality(empty, q).count() == 0 and toxicity.score_toxicity(empty, t).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([3, 1, 5])
    scores, tr, start = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pairs, z = toxicity.marginals(scores, lengths, tr, start)
    at, want_p, want_pairs = 0, [], np.zeros((2, 2))
    for k, n in enumerate(lengths):
        total, hit = 0.0, np.zeros(n)
        two = np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            e = np.exp(start[tags[0]] + sum(scores[at + i] for i in range(n) if tags[i]) + sum(tr[a, b] for a, b in itertools.pairwise(tags)))
            total += e
            hit += e * np.array(tags)
            for a, b in itertools.pairwise(tags):
                two[a, b] += e
        want_p += list(hit / total)
        want_pairs += two / total
        assert z[k] == pytest.approx(np.log(total))
        at += n
    assert p == pytest.approx(want_p) and pairs == pytest.approx(want_pairs)


@pytest.mark.parametrize("seed", range(6))
def test_expected_tags_equal_enumeration(seed):
    """Documents of several chains: every tagging of a toxic one but the clean one, weighed by the model."""
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", "<a", ">b"]
    emission, bias = dict(zip(names, rng.normal(0, 2, len(names)).tolist(), strict=True)), float(rng.normal(-1, 1))
    tr, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths, doc, toxic = [3, 1, 2, 5, 2, 1], np.array([0, 0, 0, 1, 2, 2]), np.array([True, True, True, True, False, False])
    features = [[[str(x) for x in rng.choice(names, rng.integers(0, 3), replace=False)] for _ in range(n)] for n in lengths]
    got = toxicity.expected_tags(features, toxic, doc, emission, bias, tr, start)
    for d in range(3):
        own = [k for k in range(len(lengths)) if doc[k] == d]
        total, hit = 0.0, [np.zeros(lengths[k]) for k in own]
        for tags in itertools.product(*[itertools.product((0, 1), repeat=lengths[k]) for k in own]):
            if not any(map(any, tags)):
                continue
            e = 0.0
            for k, t in zip(own, tags, strict=True):
                e += start[t[0]] + sum(bias + sum(emission[f] for f in fs) for fs, x in zip(features[k], t, strict=True) if x) + sum(tr[a, b] for a, b in itertools.pairwise(t))
            total += np.exp(e)
            for h, t in zip(hit, tags, strict=True):
                h += np.exp(e) * np.array(t)
        for k, h in zip(own, hit, strict=True):
            assert got[k] == pytest.approx(h / total if toxic[k] else np.zeros(lengths[k]))


@pytest.mark.parametrize("seed", range(3))
def test_chain_is_fitted_to_the_top(seed):
    """The likelihood with its ridge can't be raised by a step along any one weight."""
    rng = np.random.default_rng(seed)
    names = ["a", "b", "<a"]
    examples = [([[str(x) for x in rng.choice(names, rng.integers(0, 3), replace=False)] for _ in range(n)], (rng.random(n) < 0.4).astype(float)) for n in rng.integers(1, 6, 40)]
    emission, bias, tr, start = toxicity.fit_chain(examples, names, rounds=600)

    def value(theta):
        w, b, t, s = dict(zip(names, theta[:3], strict=True)), theta[3], theta[4:8].reshape(2, 2), theta[8:]
        out = -0.5 * (theta**2).sum()
        for fs, tags in examples:
            own = np.array([b + sum(w[f] for f in x) for x in fs])
            y = tags.astype(int)
            out += s[y[0]] + (own * y).sum() + sum(t[i, j] for i, j in itertools.pairwise(y)) - toxicity.marginals(own, np.array([len(y)]), t, s)[2][0]
        return out

    theta = np.concatenate([[emission[n] for n in names], [bias], tr.ravel(), start])
    for i in range(len(theta)):
        for step in (0.05, -0.05):
            other = theta.copy()
            other[i] += step
            assert value(other) < value(theta)


def test_ids_of_a_sample(spark):
    """At most n ids of each value: those of the smallest hashes, repeated rows once, null values none."""
    rows = [(i, "x" if i % 3 else None) for i in range(4000)] + [(7, "x"), (8, "y"), (8, "y")]
    df = spark.createDataFrame(rows, "doc_id long, by string")
    got = common.pick_ids(df, "by", 50).collect()
    hashed = [r.doc_id for r in df.where("by = 'x'").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    assert {r.doc_id for r in got if r.by == "x"} == set(hashed) and sorted(r.doc_id for r in got if r.by == "y") == [8]
    assert len(got) == 51


def test_marks_stay_on_their_letters():
    assert language.prepared("हिन्दी भाषा में 12!").decode() == "हिन्दी भाषा में "
    assert language.prepared("nai\u0308ve ½ Cafe\u0301_x").decode() == "nai\u0308ve cafe\u0301 x"
    assert language.prepared("ภาษาไทย, ที่").decode() == "ภาษาไทย ที่"
    assert language.prepared("Don't 3 times_").decode() == "don t times "


def _plain_sizes(raw, content, level, block):
    """The summed sizes of a text's blocks, each compressed by a new compressor under the raw dictionary."""
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = lambda t: len(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    return sum(pack(raw[i : i + block]) for i in range(0, max(len(raw), 1), block))


@pytest.fixture(scope="module")
def labelled(spark):
    return queries._labelled(spark, "/root/testdata/sf0.01").cache()


def _by_text(frame, *columns):
    return {(r.doc_id, r.n_chars): tuple(r[c] for c in columns) for r in frame.collect()}


def test_quality_equals_plain_compression(spark, odd, labelled):
    model = quality.fit_quality(labelled)
    docs = common.table(spark, D, "documents").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.score_quality(docs, model).collect())
    want = []
    for r in docs.collect():
        raw = quality.prepared(r.text)
        bad, good = (_plain_sizes(raw, x, quality.LEVEL, quality.BLOCK) for x in (model.bad, model.good))
        z = (bad - good) / (bad + good) * model.weights[0] + model.weights[1]
        want.append((r.doc_id is None, r.doc_id or 0, 1 / (1 + np.exp(-np.clip(z, -35, 35)))))
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)])
    empty_scores = {r.score for r in quality.score_quality(docs.where("text is null or text = ''"), model).collect()}
    assert len(empty_scores) == 1
    kept = quality.filter_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(s >= 0.3 for _, _, s in ((0, 0, x.score) for x in quality.score_quality(odd, model).collect()))


def test_language_equals_plain_compression(spark, odd):
    d = "/root/testdata/sf0.01"
    model = language.fit_language(common.table(spark, d, "documents"))
    docs = common.table(spark, D, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in language.identify_language(docs, model).collect())
    want = []
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            want.append((r.doc_id is None, r.doc_id or 0, "und", 0.0))
            continue
        s = [_plain_sizes(language.prepared(r.text), x, language.LEVEL, language.BLOCK) for x in model.dictionaries]
        e = [np.exp(-model.sharpness * (x - min(s)) / min(s)) for x in s]
        want.append((r.doc_id is None, r.doc_id or 0, model.languages[s.index(min(s))], max(e) / sum(e)))
    want.sort()
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_numbers_are_no_letters(spark):
    model = language.LanguageModel(("en", "de"), (b"the and of it", b"der die das und"))
    rows = [(1, "½ ² ①"), (2, "Ⅷ 12"), (3, "日"), (4, "a"), (5, "_"), (6, None)]
    got = {r.doc_id: r.lang_pred for r in language.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i for i, x in got.items() if x == "und"} == {1, 2, 5, 6}


def test_a_class_of_long_texts_has_its_examples(spark):
    rows = [(i, f"{'aeiou'[i % 5]} text of one {i}", "short") for i in range(40)] + [(100 + i, f"largo{i} " * 30_000, "long") for i in range(5)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {"short", "long"} and all(len(x) > 100 for x in model.dictionaries)


def test_toxicity_equals_plain_forward_backward(spark, odd, labelled):
    model = toxicity.fit_toxicity(labelled)
    docs = common.table(spark, D, "documents").select("doc_id", "text").unionByName(odd.where("doc_id < 6 or doc_id > 7 or doc_id is null").select("doc_id", "text"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.score_toxicity(docs, model).collect())
    want = []
    for r in docs.collect():
        p = []
        for words in toxicity.chains(r.text or ""):
            s = [model.bias + sum(model.emission.get(f, 0.0) for f in fs) for fs in toxicity.chain_features(words)]
            ahead = [[np.exp(model.start[0]), np.exp(model.start[1] + s[0])]]
            for x in s[1:]:
                a = ahead[-1]
                now = [sum(a[i] * np.exp(model.transition[i][j]) for i in (0, 1)) * (np.exp(x) if j else 1) for j in (0, 1)]
                ahead.append([v / sum(now) for v in now])
            back = [[1.0, 1.0]]
            for x in s[:0:-1]:
                b = back[-1]
                now = [np.exp(model.transition[i][0]) * b[0] + np.exp(model.transition[i][1] + x) * b[1] for i in (0, 1)]
                back.append([v / sum(now) for v in now])
            p += [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back[::-1], strict=True)]
        z = float(np.dot(toxicity.evidence(np.array(p)), model.calibration[:-1])) + model.calibration[-1]
        want.append((r.doc_id is None, r.doc_id or 0, 1 / (1 + np.exp(-np.clip(z, -35, 35)))))
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], rel=1e-6, abs=1e-9)
    assert any(x[2] > 0.5 for x in got)


def test_spans_are_the_words():
    text = "You IDIOT fool. Not this. moron"
    assert [text[a:b] for a, b in toxicity.spans(text, np.array([0, 0.9, 0.8, 0, 0.1, 0.7]))] == ["IDIOT fool", "moron"]


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    docs = common.table(spark, D, "documents")
    seen = docs.collect()
    for name, stage in pipe.STAGES[:-1]:
        docs = common.written(stage(spark, docs, D), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    mixed = docs.count()
    out = pipe.STAGES[-1][1](spark, docs, D)
    assert out.count() == mixed > 0
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in seen}


def test_pipeline_takes_odd_rows(spark, odd):
    """Columns of other names keep their values through every stage, and rows lose nothing but what a stage is for."""
    import corpus_pipeline as pipe

    more = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(77).alias(c) for c in ("n_lines", "n_deleted", "mix_repeat", "mix_weight", "_key", "row", "d", "t", "place", "others", "root", "n_tokens")])
    for frame in (more, more.where("false")):
        docs = frame
        for name, stage in pipe.STAGES[:-1]:
            after = common.written(stage(spark, docs, D), "test")
            assert after.columns == docs.columns, name
            assert {x for r in after.collect() for x in r[5:]} <= {77}, name
            docs = after
        last = pipe.STAGES[-1][1](spark, docs, D)
        assert {r.source_n_tokens for r in last.collect()} <= {77}
        assert (last.count() == 0) == (frame is not more)
    rows = [(None, "one text of its own"), (None, "and quite another one"), (8, "a third that shares an id"), (8, "with this fourth text here"), (9, "a fifth")]
    five = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOC)
    for stage in (pipe.drop_repeated_lines, pipe.drop_near_copies):
        assert sorted(r.text for r in stage(spark, five, D).collect()) == sorted(t for _, t in rows)


def test_pipeline_stages_equal_brute_force(spark, tokenizers_pair):
    """On documents as they are: each stage's output from its input, by plain code."""
    import corpus_pipeline as pipe

    docs = common.table(spark, D, "documents").where("doc_id < 60")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = common.table(spark, D, "labels").select("doc_id", "quality")
    model = quality.fit_quality(docs.where(~common.held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id"))
    want = set()
    for i, r in rows.items():
        bad, good = (_plain_sizes(quality.prepared(r.text), x, quality.LEVEL, quality.BLOCK) for x in (model.bad, model.good))
        if 1 / (1 + np.exp(-np.clip((bad - good) / (bad + good) * model.weights[0] + model.weights[1], -35, 35))) >= 0.3:
            want.add(i)
    kept = common.written(pipe.keep_quality(spark, docs, D), "test")
    assert {r.doc_id for r in kept.collect()} == want
    left = _brute_lines([(r.doc_id, r.text) for r in kept.collect()], 40)
    lines = common.written(pipe.drop_repeated_lines(spark, kept, D), "test")
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in left.items() if t or not rows[i].text}
    near = common.written(pipe.drop_near_copies(spark, lines, D), "test")
    texts, to = {r.doc_id: r.text for r in lines.collect()}, {}
    for i in sorted(texts):
        to[i] = i
        for j in [j for j in to if j < i and to[j] != to[i] and _likeness(texts[i], texts[j]) >= 0.8]:
            a, b = sorted((to[i], to[j]))
            to = {k: a if x == b else x for k, x in to.items()}
    assert {r.doc_id for r in near.collect()} == set(to.values())
    mixed = common.written(pipe.mix(spark, near, D), "test")
    drawn = mixing.mix_sources(near).groupBy("doc_id").count().collect()
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {r.doc_id: r["count"] for r in drawn}
    lib = tokenizers_pair[1]
    for r in pipe.tokenize(spark, mixed, D).collect():
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_exact_sql(spark):
    from tests.oracle import compare

    for name, sql in queries.oracle_sql().items():
        assert compare(queries.queries()[name](spark, D), sql, D) == ""


def test_near_copies_keep_texts_that_share_an_id(spark, odd):
    import corpus_pipeline as pipe

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = collections.Counter((r.doc_id, r.text and r.text[:9]) for r in pipe.drop_near_copies(spark, docs, D).collect())
    # (null, null), 4 and 5 are copies of 3, 2 is one of 1 and 7 one of 6; a text of its own stays, whatever its id.
    assert kept == collections.Counter([(1, "Hello the"), (3, None), (None, "a null id"), (6, "w0 w1 w2 "), (8, "ÀÉ ß İ Σ "), (8, "another t")])
    rows = [(None, f"text number {i} of {i * i} has words {i + 7} like {i**3}", "en", "a", 9) for i in range(40)]
    assert pipe.drop_near_copies(spark, spark.createDataFrame(rows * 2, DOC), D).count() == 40


def _tuples(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _likeness(a, b):
    a, b = _tuples(a), _tuples(b)
    return len(a & b) / len(a | b)


def _planted(rng, edits, n=400):
    """A text of n words and a copy in which this many words, apart from one another, are others."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    copy = list(words)
    for i in rng.sample(range(5, n - 5, 6), edits):
        copy[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words), " ".join(copy)


def test_near_copies_of_four_fifths_are_candidates():
    rng = random.Random(3)
    for edits in (2, 4, 6, 8):  # likeness 0.95 to 0.82
        missed = 0
        for _ in range(150):
            a, b = (near_copies.shingles(near_copies.words_of(t)) for t in _planted(rng, edits))
            assert len(np.intersect1d(a, b)) >= near_copies.LIKENESS * len(np.union1d(a, b))
            near = bin(near_copies.simhash_of(a) ^ near_copies.simhash_of(b)).count("1") <= near_copies.REACH
            missed += not (near and (near_copies.bands(a) == near_copies.bands(b)).any())
        assert missed <= 1


def test_pipeline_drops_planted_near_copies(spark, monkeypatch):
    import corpus_pipeline as pipe

    rng = random.Random(4)
    texts = [t for i in range(30) for t in _planted(rng, 1 + i % 14)]  # likeness 0.97 to 0.7
    chain = [_planted(rng, 0)[0]]
    for _ in range(11):  # each is like the one before, the ends are not alike
        words = chain[-1].split()
        for i in rng.sample(range(5, 395, 6), 6):
            words[i] = f"y{rng.randrange(10**6)}"
        chain.append(" ".join(words))
    texts += chain + ["a b c", "A  b c", "a b d", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC)
    to = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if _likeness(texts[i] or "", texts[j] or "") >= 0.8:
            to = [to[i] if x == to[j] else x for x in to]
    want = {to.index(x) for x in to}
    assert 40 < len(want) < 60
    assert {r.doc_id for r in pipe.drop_near_copies(spark, docs, D).collect()} == want
    monkeypatch.setattr(near_copies, "BLOCK", 3)  # pools of several blocks
    assert {r.doc_id for r in pipe.drop_near_copies(spark, docs, D).collect()} == want


def test_rings_are_those_of_vantage_points():
    rng = np.random.default_rng(8)
    a, b = (near_copies.fingerprint(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (700, 3))
    few = rng.integers(0, 2**64, 600, dtype=np.uint64)
    bits = np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert near_copies.simhash_of(few) == sum(1 << i for i in range(64) if 2 * bits[i] > 600) == near_copies.fingerprint(few)[0]
    found = near_copies.rings(np.stack([a, b]))
    assert found.shape == (2, near_copies.METRICS) and len(np.unique(found)) > near_copies.METRICS
    m = 0
    for word in range(near_copies.CHECK, near_copies.WORDS):
        for at in range(0, 60, near_copies.PLACES):
            mask = ((1 << near_copies.PLACES) - 1) << at
            ab = [[bin((int(x[word]) ^ v) & mask).count("1") for v in simhash.vantage_points(mask)] for x in (a, b)]
            assert (ab[0] == ab[1]) == (found[0, m] == found[1, m])
            m += 1
    assert m == near_copies.METRICS


def test_four_fifths_share_a_ring_whatever_the_size():
    rng, missed = np.random.default_rng(9), 0
    for n, less in ((5, 1), (6, 1), (9, 1), (10, 2), (50, 10), (300, 60)):
        for _ in range(300):
            x = rng.integers(0, 2**64, n, dtype=np.uint64)
            a, b = near_copies.fingerprint(x), near_copies.fingerprint(x[: n - less])
            near = np.bitwise_count(a ^ b)[: near_copies.CHECK].sum() <= near_copies.CHECK_REACH
            missed += not (near and (near_copies.rings(a[None]) == near_copies.rings(b[None])).any())
    assert missed <= 2


def test_near_copies_come_through_vantage_rings(spark, monkeypatch):
    """Links of fingerprints of several words, whole and in blocks, join what all pairs do; the stage has no others."""
    import corpus_pipeline as pipe

    rng = random.Random(12)
    base = _planted(rng, 0)[0].split()
    texts = [t for i in range(8) for t in _planted(rng, 1 + i)]
    for i in range(60):  # a hot group, next to which are other texts
        texts.append(" ".join(base[:200] + [f"z{rng.randrange(10**6)}" for _ in range(i // 6)] + base[200:]))
    prints = np.stack([near_copies.fingerprint(near_copies.shingles(near_copies.words_of(t))) for t in texts])
    keys = near_copies.rings(prints)
    names = [int(x) for x in prints[:, 0].view(np.int64)]
    brute = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (keys[i] == keys[j]).any() and np.bitwise_count(prints[i] ^ prints[j])[: near_copies.CHECK].sum() <= near_copies.CHECK_REACH:
            brute.add((names[i], names[j]))

    def classes(edges):
        frame = spark.createDataFrame(sorted(edges), "u long, v long")
        return {r.node: r.root for r in components.components(frame).collect()}

    df = spark.createDataFrame([(i, [int(x) for x in p.view(np.int64)]) for i, p in enumerate(prints)], "w long, fp array<long>")
    assert classes({(r.u, r.v) for r in near_copies.candidates(df).collect()}) == classes(brute)
    monkeypatch.setattr(near_copies, "COUNTED", 1)
    monkeypatch.setattr(simhash, "BLOCK", 10)
    assert classes({(r.u, r.v) for r in near_copies.candidates(df).collect()}) == classes(brute)

    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC)
    assert pipe.drop_near_copies(spark, docs, D).count() == 9
    monkeypatch.setattr(simhash, "ring_links", lambda rows, *_: spark.createDataFrame([], "u long, v long"))
    assert pipe.drop_near_copies(spark, docs, D).count() == len(set(names)) > 50  # texts of one first word still meet
