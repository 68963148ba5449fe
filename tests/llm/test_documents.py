"""The operators on documents against brute force, on the smallest table and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tallywork.llm.bpe as bpe
import tallywork.llm.jaccard as jaccard
import tallywork.llm.packing as packing
from tallywork.llm import common, licenses, linededup, quality, sharding, tokencounts
from tallywork.llm.common import components

SF = "/root/testdata/sf0.001"
MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, shard int, component string"
WORDS = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6))
ODD = [
    (1, None, "en", "a", 1, 1, "x"), (2, "", "en", None, 1, 1, "x"), (3, "one", None, "a", 1, 1, "x"), (4, "One two", "en", "a", 1, 1, "x"), (5, "one  two", "en", "a", 1, 1, "x"), (6, " \n\t\n ", "en", "a", 1, 1, "x"),
    (7, WORDS, "en", "a", 1, 1, "x"), (7, WORDS, "en", "a", 1, 1, "x"), (8, "start\n" + WORDS + "\nend", "en", "a", 1, 1, "x"), (9, WORDS.replace("w0x0", "changed"), "en", "a", 1, 1, "x"), (10, "é日本🙂 " * 40, "de", "b", 1, 1, "x"),
    (11, "spam$$$ " * 80, "de", "b", 1, 1, "x"), (12, "a" * 5000, "de", "b", 1, 1, "x"), (13, "long text of words " * 20000, "de", "b", 1, 1, "x"), (14, "under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0", "de", "b", 1, 1, "x"),
]

CLASHES = """ids n_tokens decoded size text_crc32 law shard slot grown_shard key own part n_lines n_removed removed lines first_line text_key __key n_words rate
    word_chars n_symbols n_dup_lines n_repeat_words base_failed kept cutoff docs start length doc_tokens sequence_id offset section field spans labels score base_labels
    n_shingles component_id component digest tokens short id n grp""".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def both(docs, odd):
    """The smallest table and the odd rows, under ids of their own, with columns named like those that the operators use and return."""
    rows = docs.select((F.col("doc_id") + 100).alias("doc_id"), "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1: BPE ------------------------------------------------------------------------------------------------------------


def reference(path):
    coder = bpe.codec(path, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abt he's\n\t1 é日🙂%")), max_size=60))
def test_bpe_halves_join_to_the_whole(text):
    coder, was = bpe.codec(MULTI, P.PATTERN), (bpe.LEAF_CHARS, bpe.LEAF_BYTES)
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = 5, 3
    try:
        coder.memo.clear()
        assert coder.encode(text).tolist() == reference(MULTI).encode_ordinary(text)
        assert coder.decode(coder.encode(text).tolist()) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = was
        coder.memo.clear()


def test_bpe_documents(spark, both):
    enc = reference(MULTI)
    got = bpe.decode_documents(bpe.encode_documents(both, MULTI, P.PATTERN), MULTI, P.PATTERN).collect()
    want = [(i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts(both)]
    assert sorted((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == sorted(want)
    assert bpe.encode_documents(empty(spark), MULTI, P.PATTERN).count() == 0


# -- 2: sharding -------------------------------------------------------------------------------------------------------


def best(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("digits", [1, 3])
def test_sharding_finds_the_smallest_capacity(spark, digits):
    rnd, was = random.Random(5), (sharding.DIGITS, sharding.HEAVY)
    sharding.DIGITS, sharding.HEAVY = digits, 8
    try:
        for shards in (2, 5):
            rows = [(hashlib.sha256(str(i).encode()).hexdigest(), rnd.randint(1, 60)) for i in range(300)]
            shard_of, starts, first = sharding.split(spark.createDataFrame(rows, "key string, bytes long"), shards)
            load = Counter()
            for key, n in rows:
                load[shard_of.get(key, first + sum(key >= s for s in starts))] += n
            total = sum(n for _, n in rows)
            heavy = sorted(k for k, n in rows if n * sharding.HEAVY >= total)
            assert max(load.values()) == best([dict(rows)[k] for k in heavy] + [n for k, n in sorted(rows) if k not in heavy], shards)
    finally:
        sharding.DIGITS, sharding.HEAVY = was


def test_sharding_documents(spark, both):
    got = sharding.shard_documents(both).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(both))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, shard_of = defaultdict(list), defaultdict(set)
    text_of = defaultdict(set)
    for i, t in texts(both):
        text_of[i].add(t)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        for t in text_of[r["doc_id"]]:
            shard_of[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values()) and set(slots) <= set(range(8))
    assert sharding.shard_documents(empty(spark)).count() == 0


# -- 3: line dedup -----------------------------------------------------------------------------------------------------


def repeated_lines(rows, least=50):
    """Lines of runs of at least `least` words that stand earlier: all runs of all documents, none shortened."""
    ordered = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    runs, first = [], {}
    for d, (_, t) in enumerate(ordered):
        lines = t.split("\n")
        size = [len(x.encode().split()) for x in lines]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += size[b]
                if n >= least:
                    run = tuple(lines[a : b + 1])
                    runs.append((d, a, b, run))
                    first.setdefault(run, (d, a))
    gone = defaultdict(set)
    for d, a, b, run in runs:
        if first[run] < (d, a):
            gone[ordered[d]] |= set(range(a, b + 1))
    return {x: sorted(gone[x]) for x in ordered}


def test_line_dedup(spark, both):
    want = repeated_lines(texts(both))
    got = linededup.dedup_lines(both).collect()
    before = Counter(i for i, _ in texts(both))
    assert Counter(r["doc_id"] for r in got) == before
    cleaned = Counter((r["doc_id"], tuple(r["removed"]), r["text"]) for r in got)
    expected = Counter()
    for i, t in texts(both):
        lines = [] if t is None else want[(i, t)]
        expected[(i, tuple(lines), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines))] += 1
    assert cleaned == expected
    assert any(r["n_removed"] for r in got) and linededup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1 << 29, 0])
def test_line_dedup_with_and_without_the_bitmap(both, bits, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", bits)
    want = repeated_lines(texts(both))
    got = {(r["doc_id"], tuple(r["removed"])) for r in linededup.dedup_lines(both).collect() if r["n_removed"]}
    assert got == {(i, tuple(lines)) for (i, _), lines in want.items() if lines}


def test_line_matches_extend_along_their_source(both):
    """Runs equal their sources line for line, are long enough and earlier, and none continues another; together they are the lines to delete."""
    of = {(i, hashlib.md5(t.encode()).hexdigest()): t.split("\n") for i, t in texts(both) if t is not None}
    gone, runs = defaultdict(set), linededup.line_matches(both).collect()
    for r in runs:
        n = r["last_line"] - r["first_line"] + 1
        run = of[r["doc_id"], r["text_key"]][r["first_line"] : r["last_line"] + 1]
        assert run == of[r["source_id"], r["source_key"]][r["source_line"] : r["source_line"] + n] and sum(len(x.split()) for x in run) >= 50
        assert (r["source_id"], r["source_key"], r["source_line"]) < (r["doc_id"], r["text_key"], r["first_line"])
        gone[r["doc_id"], "\n".join(of[r["doc_id"], r["text_key"]])] |= set(range(r["first_line"], r["last_line"] + 1))
    ends = {(r["doc_id"], r["text_key"], r["source_id"], r["source_key"], r["last_line"], r["source_line"] - r["first_line"]) for r in runs}
    assert not any((r["doc_id"], r["text_key"], r["source_id"], r["source_key"], r["first_line"] - 1, r["source_line"] - r["first_line"]) in ends for r in runs)
    assert {k: sorted(v) for k, v in gone.items()} == {k: v for k, v in repeated_lines(texts(both)).items() if v}


def test_line_dedup_columns(odd):
    clash = odd.withColumns({"n_lines": F.lit("x"), "removed": F.lit(1)})
    assert linededup.dedup_lines(clash).columns == [*odd.columns, "n_lines", "n_removed", "removed"]


# -- 4: quality rules --------------------------------------------------------------------------------------------------


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked)


def test_quality_rules(spark, both):
    got = quality.judge_documents(both).collect()
    want = Counter()
    for i, t in texts(both):
        c = counted(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = Counter(r["doc_id"] for r in got if r["kept"])
    assert Counter(r["doc_id"] for r in quality.filter_documents(both).collect()) == kept
    assert quality.judge_documents(empty(spark)).count() == quality.filter_documents(empty(spark)).count() == 0


def test_quality_cutoffs_spare_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge_documents(docs).join(labels, "doc_id").where("not base_failed")
    clean, junk = judged.where("quality = 1").count(), judged.where("quality = 0").count()
    assert judged.where("quality = 1 and kept").count() >= 0.99 * clean and judged.where("quality = 0 and kept").count() <= 0.1 * junk


def test_quality_cutoffs_follow_the_group(spark):
    """A rate that fails in one source passes in another whose documents are all like that; junk doesn't excuse itself."""
    rnd, rows = random.Random(8), []
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))

    def text(size, symbols):
        words = [word(size + rnd.randint(-1, 1)) for _ in range(120)]
        return " ".join(w + "#" * (k < symbols) for k, w in enumerate(words))

    rows += [(i, text(5, rnd.randint(0, 3)), "en", "plain") for i in range(700)]
    rows += [(1000 + i, text(8, rnd.randint(0, 3)), "en", "learned") for i in range(700)]
    rows += [(2000 + i, text(5, 70 if i % 10 < 3 else 0), "en", "spoilt") for i in range(400)]
    rows += [(3000, text(9, 0), "en", "plain"), (3001, text(9, 0), "en", "learned"), (3002, text(5, 24), "en", "plain")]  # 3002: 200 in 1,000, with symbols
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc_id"] for r in quality.filter_documents(docs).collect()}
    assert 3000 not in kept and 3001 in kept and 3002 not in kept
    assert not any(2000 + i in kept for i in range(400) if i % 10 < 3) and all(2000 + i in kept for i in range(400) if i % 10 >= 3)
    assert len([i for i in kept if i < 2000]) > 0.98 * 1400
    limits = {r["source"]: r for r in quality.thresholds(quality.measure_documents(docs)).collect()}
    assert limits["learned"]["max_chars"] > 1.2 * limits["plain"]["max_chars"]


# -- 6: packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("epoch", [1 << 22, 3000])
def test_packing(spark, both, epoch, monkeypatch):
    """Every id of every row lies in one piece; sequences are gapless; few are padded. The small EPOCH makes windows exchange pieces often."""
    monkeypatch.setattr(packing, "EPOCH", epoch)
    enc, rows = unaltered(), both
    ids = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts(rows)}
    copies = Counter(i for i, _ in texts(rows))
    covered, per_sequence = {i: [0] * len(x) for i, x in ids.items()}, defaultdict(list)
    for r in packing.pack_documents(rows, PLAIN, P.PATTERN).collect():
        doc, at = r["doc_id"], r["start"]
        got = [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)]
        assert r["length"] == len(got) and r["doc_tokens"] == len(ids[doc]) and ids[doc][at : at + len(got)] == got
        for k in range(at, at + len(got)):
            covered[doc][k] += 1
        per_sequence[r["sequence_id"]].append((r["offset"], len(got)))
    assert max(copies.values()) == 2 and all(set(c) == {copies[i]} for i, c in covered.items())
    sizes = []
    for v in per_sequence.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 1024 and sum(s < 1024 for s in sizes) <= rows.rdd.getNumPartitions()


def test_packing_holds_an_epoch_at_most():
    p, most = packing.Packer(10), 0
    for row in range(3000):  # no two of these fit into one window
        list(p.place(row, b"x" * 24))
        most = max(most, sum(map(len, p.open)))
        if row % 100 == 99:
            assert sum(len(x[2]) for w in p.pour(keep=True) for x in w) <= 100 * 24 + 40 and sum(map(len, p.open)) <= 1
    assert most <= 101


def test_packing_prefers_levels_that_even_out():
    p = packing.Packer(10)
    assert not list(p.place(0, b"x" * 24)) and not list(p.place(1, b"y" * 24)) and p.level[6] == 2
    full = list(p.place(2, b"z" * 16))
    assert [x[0] for x in full[0]] == [1, 2] and p.level[6] == 1


def unaltered():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_packing_ids_are_those_of_the_json_vocabulary(docs):
    t, enc, rnd = unaltered(), packing.encoder(PLAIN, P.PATTERN, tuple(packing.SPECIAL.items())), random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "x", " y1", "é", "<", "\x1c", "\x85", "'s"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    for text in [*[x for _, x in texts(docs)], *odd, "a<|endoftext|>b", "x <|endoftext|> y", "\x1c \x85 x  \n"]:
        assert enc(text) == t.encode(text, add_special_tokens=False).ids
    assert enc("x <|endoftext|> y") == [87, 220, 50256, 331]


def test_packing_empty(spark):
    assert packing.pack_documents(empty(spark), PLAIN, P.PATTERN).count() == 0
    assert [r["length"] for r in packing.pack_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), PLAIN, P.PATTERN).collect()] == [1]


# -- 8: token counts ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, both, rule):
    rows, want, copies = both, {}, Counter(i for i, _ in texts(both))
    enc = reference(PLAIN)
    for i, text in dict(texts(rows)).items():
        text, at = text or "", 0
        spans = []
        for k, line in enumerate(text.split("\n")):
            end = min(at + len(line) + 1, len(text))
            spans.append((at, end))
            want[(i, k)] = 0
            at = end
        raw = [len(c.encode()) for c in text]
        char = [k for k, n in enumerate(raw) for _ in range(n)]
        at = 0
        for token in enc.encode_ordinary(text):
            n = len(enc.decode_single_token_bytes(token))
            a, b = char[at], char[at + n - 1] + 1
            at += n
            share = [max(0, min(b, e) - max(a, s)) for s, e in spans]
            k = [j for j, x in enumerate(share) if x]
            own = k[0] if rule == "first" else k[-1] if rule == "last" else max(k, key=lambda j: (share[j], -j))
            want[(i, own)] += 1
    got = tokencounts.count_section_tokens(rows, PLAIN, P.PATTERN, rule=rule).collect()
    assert Counter((r["doc_id"], r["section"], r["n_tokens"]) for r in got) == Counter({(i, k, n): copies[i] for (i, k), n in want.items()})
    assert all(s == d for s, d in [(sum(x["n_tokens"] for x in g), copies[g[0]["doc_id"]] * g[0]["doc_tokens"]) for g in _by(got, "doc_id")])


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out.values()


def test_token_counts_of_fields(spark):
    rows = spark.createDataFrame([(1, "user", "hello there\nyou"), (2, None, None)], "doc_id long, role string, text string")
    got = {(r["doc_id"], r["field"], r["section"]): r["n_tokens"] for r in tokencounts.count_section_tokens(rows, PLAIN, P.PATTERN, ("role", "text")).collect()}
    assert set(got) == {(1, "role", 0), (1, "text", 0), (1, "text", 1), (2, "role", 0), (2, "text", 0)} and got[(2, "text", 0)] == 0
    assert tokencounts.count_section_tokens(empty(spark), PLAIN, P.PATTERN).count() == 0


def test_token_counts_encode_a_slice_at_once(monkeypatch):
    """op8: texts are encoded in one call, with the spans that each has by itself, empty texts and cut characters among them."""
    calls, encode = [], bpe.ByteBPE.encode_many
    monkeypatch.setattr(bpe.ByteBPE, "encode_many", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    texts = ["", "plain words\n", "", "日本 🙂é\n\nx", "a  b\n", ""]
    starts, ends, counts = tokencounts.token_spans(PLAIN, P.PATTERN, texts)
    assert calls == [len(texts)]
    at, low = np.cumsum([0, *map(len, texts)]), np.cumsum([0, *counts])
    for n, text in enumerate(texts):
        a, b, _ = tokencounts.token_spans(PLAIN, P.PATTERN, [text])
        assert (starts[low[n] : low[n + 1]] - at[n]).tolist() == a.tolist() and (ends[low[n] : low[n + 1]] - at[n]).tolist() == b.tolist()


# -- 9: licenses -------------------------------------------------------------------------------------------------------


def test_license_base_places(spark, both):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = Counter((r["doc_id"], r["n_words"], tuple(r["base_spans"]), r["base_labels"]) for r in licenses.scan_licenses(both).collect())
    want = Counter()
    for i, t in texts(both):
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hits = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        want[(i, len(words), tuple(k for k, _ in hits), ",".join(sorted({x for _, x in hits})))] += 1
    assert got == want and licenses.scan_licenses(empty(spark)).count() == 0


def test_license_templates():
    a = licenses.compile_template("t", "one two <<optional>> three <<any:2>> <</optional>> four <<any:2>> five")
    ok = ["one two four five", "one two three four five", "one two three x y four five", "one two four x y five", "z one two four x five z"]
    no = ["one two", "one two three x y z four five", "one two four x y z five", "one four five", "one two x four five"]
    found = lambda a, t: licenses.places(a, t.split(), f" {t} ")[0]
    assert all(found(a, t) for t in ok) and not any(found(a, t) for t in no)
    b = licenses.compile_template("t", "<<optional>> <<any:3>> by <<optional>> all <</optional>> <</optional>> <<any:2>> a b <<any:9>> <<optional>> c <</optional>>")
    assert found(b, "x a b y") == [1] and found(b, "by all a b c") == [2]
    for markup in ("<<optional>> a <</optional>>", "<<optional>> a", "a <</optional>> b", "a <<some>> b", ""):
        with pytest.raises(ValueError):
            licenses.compile_template("t", markup)


def test_license_overlapping_places():
    a = licenses.compile_template("t", "a a")
    assert licenses.places(a, ["a"] * 4, " a a a a ") == ([0, 1, 2], 1.0)


def regions(markup):
    """A template as nested lists: a word, an int for up to so many words, a list for an optional region."""
    stack = [[]]
    for part in markup.replace("<<", " <<").replace(">>", ">> ").split():
        if part == "<<optional>>":
            stack.append([])
        elif part == "<</optional>>":
            done = stack.pop()
            stack[-1].append(done)
        elif part.startswith("<<any:"):
            stack[-1].append(int(part[6:-2]))
        else:
            stack[-1] += licenses.words_of(part)
    return stack[0]


def as_pattern(parts):
    return "".join(f"(?:{as_pattern(x)})?" if isinstance(x, list) else f"(?:[^ ]+ ){{0,{x}}}" if isinstance(x, int) else f"{re.escape(x)} " for x in parts)


def spelled(parts, rnd):
    """A text that a template accepts."""
    out = []
    for x in parts:
        if isinstance(x, list):
            out += spelled(x, rnd) if rnd.random() < 0.5 else []
        else:
            out += [f"n{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, x))] if isinstance(x, int) else [x]
    return out


def test_license_labels_and_scores_of_the_registered_templates(spark):
    """Against regular expressions made from the markup by themselves: labels, and score where a template is accepted or nothing stands."""
    rnd, rows, want = random.Random(12), [], {}
    patterns = {k: re.compile("(?:^| )" + as_pattern(regions(m))) for k, m in licenses.TEMPLATES.items()}
    assert len(patterns) >= 20
    for label, markup in licenses.TEMPLATES.items():
        for kind in range(8):
            words = spelled(regions(markup), rnd)
            if kind % 4 == 1:
                words[rnd.randrange(len(words))] = "changed"
            if kind % 4 == 2:
                words = words[: max(1, len(words) - 3)]
            if kind % 4 == 3:
                words = [*[f"p{k}" for k in range(rnd.randint(0, 40))], *words, "the", "end", *(["under", "the", "mit", "license"] if kind == 7 else [])]
            rows.append((len(rows), "".join((w.upper() if rnd.random() < 0.2 else w) + rnd.choice([" ", ", ", "\n", ". "]) for w in words)))
    rows += [(len(rows), None), (len(rows) + 1, "nothing of the kind")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        line = " ".join(licenses.words_of(text)) + " "
        want = {k for k, p in patterns.items() if p.search(line)}
        base = {v for k, v in licenses.PHRASES.items() if f" {k} " in f" {line}"}
        assert set(filter(None, got[i]["labels"].split(","))) == want | base and set(filter(None, got[i]["base_labels"].split(","))) == base
        assert (got[i]["score"] == 1) == bool(want) and (not base or got[i]["score"] >= 0.5)
    assert got[len(rows) - 1]["score"] == got[len(rows) - 2]["score"] == 0
    assert all(f"{k}" in " ".join(r["labels"] for r in got.values()) for k in licenses.TEMPLATES)


def test_license_score_is_the_share_that_stands(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f x h"), (3, "a b c d"), (4, "a b c"), (5, "h g"), (6, "x a b c d e a b c d e f g")]
    got = {r["doc_id"]: r["score"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates={"t": "a b c d e f g h"}).collect()}
    assert got == {1: 1.0, 2: 0.75, 3: 0.5, 4: 0.0, 5: 0.0, 6: 0.875}


# -- 10: n-gram Jaccard join -------------------------------------------------------------------------------------------


def exact_components(rows, percent=90):
    sets, inverse, parent = {}, defaultdict(list), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
        parent[i] = i
        for x in sets[i]:
            inverse[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = Counter((a, b) for v in inverse.values() for n, a in enumerate(v) for b in v[n + 1 :] if a != b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(n=60, words=60):
    rnd, rows = random.Random(3), []
    for i in range(n):
        base = [f"b{i % 4}w{j}" for j in range(words + i % 4 * 7)]
        for _ in range(rnd.randint(0, 3)):
            base[rnd.randrange(len(base))] = f"r{rnd.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(base)))
    return rows + [(2000 + i, " ".join(f"s{i}w{j}" for j in range(rnd.randint(1, 9)))) for i in range(30)] + [(2100 + i, " ".join(f"s{i}w{j}" for j in range(4))) for i in range(30)]


@pytest.mark.parametrize("block", [128, 5])
def test_jaccard_components(spark, both, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDE", 16)
    extra = spark.createDataFrame(near_copies(), "doc_id long, text string")
    rows = both.select("doc_id", "text").unionByName(extra).repartition(5)
    want = exact_components(texts(rows))
    got = jaccard.jaccard_components(rows, 90, 3).collect()
    assert len(got) == rows.count() and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_hot_tokens_are_ranked_last_without_loss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    rows = spark.createDataFrame(near_copies(80, 40), "doc_id long, text string")
    got = jaccard.jaccard_components(rows, 90, 3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == exact_components(texts(rows))


@pytest.mark.parametrize("hubs", [1, 8])
def test_jaccard_large_group_of_chains(spark, hubs, monkeypatch):
    """One candidate group of many: a text drifts word by word, so that hubs join neighbours only, and some members link with nothing."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    monkeypatch.setattr(jaccard, "WIDE_GROUP", 6 if hubs == 8 else 4096)
    words, rows = [f"w{j}" for j in range(90)], []
    for i in range(70):
        words = [*words]
        for at in random.Random(i).sample(range(90), 1 if i % 23 else 30):
            words[at] = f"c{i}x{at}"
        rows.append((500 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = exact_components(texts(df))
    assert 1 < len({c for _, c in want.values()}) < 30
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, 90, 3).collect()} == want


def test_matching(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 700, i) for i in range(1000)] + [(None, 1)], "doc_id long, x int")
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"))
    for bits in (1 << 29, 0):
        monkeypatch.setattr(common, "MOST_BITS", bits)
        for how in ("left_semi", "left_anti"):
            got = sorted(map(tuple, common.matching(rows, ids, how).collect()), key=str)
            assert got == sorted(map(tuple, rows.join(ids, "doc_id", how).collect()), key=str) and len(got) > 100


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_components_in_chunks(spark, chunk, monkeypatch):
    """edges of several chunks take rounds, those of one chunk none; a star of which the centre is the largest id, a chain, and repeated edges."""
    names, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: (names.append(name), cut(df, name))[1])
    monkeypatch.setattr(common, "CHUNK", chunk, raising=False)
    edges = [(i, 50) for i in range(40, 50)] + [(100 + i * 7 % 11, 100 + (i + 1) * 7 % 11) for i in range(10)] + [(40, 50), (50, 40), (3, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    assert got == {i: 40 for i in range(40, 51)} | {i: 100 for i in range(100, 111)} and (len(names) > 2) == (chunk < 50)


def test_jaccard_broadcasts_counted_tables_only(spark, monkeypatch):
    """tables that grow with the documents aren't built in the driver, however small their compressed files are."""
    plans, cut, nothing = [], jaccard.cut, lambda df, rows=0: df.hint("merge")
    for module in (jaccard, common):
        monkeypatch.setattr(module, "cut", lambda df, name: (out := cut(df, name), plans.append((name, df._jdf.queryExecution().executedPlan().toString())))[0])
        monkeypatch.setattr(module, "bounded", nothing)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(common, "CHUNK", 5, raising=False)
    rows = spark.createDataFrame(near_copies(), "doc_id long, text string")
    out = jaccard.jaccard_components(rows, 90, 3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == exact_components(texts(rows))
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    built = {name for name, plan in plans if "BroadcastHashJoin" in plan and "bitmap" not in plan}
    assert built <= {"order2-wide"} and len(plans) > 20  # there a name for each group of more than WIDE_GROUP is broadcast


def test_frequent_tokens_are_marked_by_one_join(spark, monkeypatch):
    """op10: tokens of a large group of near copies aren't joined out of the others; each row of a token is marked once, and groups are as before."""
    plans, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), cut(df, name))[1])
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    pools = spark.createDataFrame([(k, 3, [4, 8, 100 + 4 * k]) for k in range(40)] + [(90, 3, [12]), (91, 3, [12]), (92, 3, [16])], "key long, short int, tokens array<long>")
    groups = {r["key"]: r["grp"] for r in jaccard.order_groups(pools, 0, "marked").collect()}
    assert len({groups[k] for k in range(40)}) == 1 and groups[90] == groups[91] != groups[0] and 92 not in groups
    plan = dict(plans)["marked-prefixes"]
    assert "LeftSemi" not in plan and "LeftAnti" not in plan


def test_packing_gives_small_batches():
    assert packing.GIVEN * 4 * 1024 <= 1 << 21 and packing.EPOCH * 4 <= 1 << 22  # bytes of ids that a task gives at once, and holds
