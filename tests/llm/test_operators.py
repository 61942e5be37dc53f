"""Operators against brute force, and their defined results on odd input."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, lines, mixing, near_duplicates, packing, quality, registry, secrets, substrings, suffixes, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "a"), (4, "x " * 3000), (4, "x " * 3000), (5, "ab cd ef gh ij kl " * 40),
    (6, "ab cd ef gh ij kl " * 40), (None, "some words here that nobody else has at all"), (7, "é ü ß " * 300)
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(i, t, "s", "en", 0, "clash") for i, t in ODD],
        "doc_id long, text string, source string, lang string, n_chars long, k string"
    )


def rows(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def listed(found):
    return sorted(map(tuple, found), key=lambda r: tuple(map(str, r)))


def brute_bytes(docs, width=400):
    texts = [(i, t.encode()) for i, t in docs]
    seen = Counter(b[s : s + width] for _, b in texts for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return listed(out)


def brute_words(docs, width=20):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256(d[1].encode()).digest())):
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return listed(out)


def morse(n):
    """Thue-Morse word of n letters and its complement: equal under polynomial hashes modulo powers of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))


@pytest.fixture(scope="module")
def alike(spark):
    """Texts that differ only in one Thue-Morse word, among shared words."""
    one, two = morse(1024)
    words = " ".join(f"w{i}" for i in range(10))
    return spark.createDataFrame(
        [(1, f"{words} {one} {words}"), (2, f"{words} {two} {words}"), (3, f"{one}\n{two}\nend")],
        "doc_id long, text string"
    )


@pytest.mark.parametrize("bucket", [16 << 20, 1 << 15])
def test_repeated_bytes(docs, odd, alike, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    for d in (docs, odd, alike, odd.limit(0)):
        assert listed(substrings.remove_repeated_bytes(d).collect()) == brute_bytes(pairs(d))


def test_repeated_words(docs, odd, alike):
    for d in (docs, odd, alike, odd.limit(0)):
        assert listed(substrings.remove_repeated_words(d).collect()) == brute_words(pairs(d))


def test_repeats_among_runs_and_few_words(spark):
    """Texts of two to four words with runs, cut and joined anew, so that repeats begin and end everywhere."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(150):
        vocabulary = "a b c d".split()[: 2 + k % 3]
        w = [x for x in rng.choice(vocabulary, 60) for _ in range(rng.integers(1, 4 if k % 2 else 2))]
        if texts and k % 3:
            old = texts[rng.integers(len(texts))][1].split()
            a, b = sorted(rng.integers(0, len(old) + 1, 2))
            w = w[: rng.integers(0, 30)] + old[a:b] + w[30 : 30 + rng.integers(0, 30)]
        texts.append((k, " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert listed(substrings.remove_repeated_words(d).collect()) == brute_words(texts)
    assert listed(substrings.remove_repeated_bytes(d, 60).collect()) == brute_bytes(texts, 60)


def test_recompression_names(spark):
    d = spark.createDataFrame([(0, b"x x x a b c a b c q"), (1, b"y x x x a b c a b c")], "sid long, text binary")
    names = substrings.symbol_names(d)
    assert names.groupBy("round").count().where("round < 2").orderBy("round").collect() == [(0, 6), (1, 1)]
    assert names.where("round = 1").first().n == 2 and substrings.name_clashes(names) == 0
    column = pa.array([b"p q r s t u v w x a b c a b c d e f g h", b"x a b c a b c d e f g h"], pa.binary())
    *_, first, rounds = substrings._parsed(column)
    last = rounds[-1]
    one, two = (last.name[(last.start >= a) & (last.start < b)].tolist() for a, b in zip(first[:-1], first[1:]))
    assert one[-2:] == two[-2:] and len(last.name) < len(rounds[0].name)


def test_tables_start_few_processes_and_are_verified(spark, docs):
    """A process for each file and each task's folder, none for checksum files; a table's damage is told."""
    jvm = f"/proc/{spark.sparkContext._jvm.ProcessHandle.current().pid()}/stat"

    def faults():  # of the processes that the JVM started and that have ended
        return int(Path(jvm).read_text().rpartition(")")[2].split()[8])

    numbers = spark.range(0, 4000, 1, 40)
    common.table(numbers, "first")
    one = faults()
    numbers.write.parquet(common.shared_dir(spark) + f"/plain-{uuid.uuid4().hex}")
    two = faults()
    found = common.table(numbers, "few")
    assert faults() - two < 0.8 * (two - one)
    assert sorted(r.id for r in found.collect()) == list(range(4000))
    folder = Path(found.table_path)
    assert not list(folder.glob(".part*.crc"))
    part = max(folder.glob("part*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 4] ^= 1  # in the page's values, the footer is longer than they are
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum|could not read|cannot read"):
        spark.read.options(**common.VERIFIED).schema(found.schema).parquet(found.table_path).collect()
    common.forget(found)


def test_names_are_not_written(docs, monkeypatch):
    tags = []
    monkeypatch.setattr(substrings, "table", lambda df, tag: tags.append(tag) or common.table(df, tag))
    substrings.remove_repeated_words(docs)
    assert "spans" in tags and "names" not in tags


def test_suffix_order():
    rng = np.random.default_rng(0)
    found = [
        bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(2000)
    ] + [b"a" * k for k in range(30)] + [b"", b"\0", b"\0\0"] * 3
    strings = suffixes.Strings(np.frombuffer(b"".join(found), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in found]))))
    order = suffixes.multikey_quicksort(strings)
    assert [found[i] for i in order] == sorted(found)
    common = suffixes.common_prefix(strings, order)
    for a, b, n in zip(order[:-1], order[1:], common.tolist()):
        x, y = found[a], found[b]
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_near_duplicates(docs, odd, alike):
    for d in (docs, alike, odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")):
        sets = {}
        for i, t in pairs(d):
            w = t.encode().lower().split()
            sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        ids = sorted(sets)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        want = {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
        assert rows(near_duplicates.near_duplicates(d), "n_shingles", "component_id", "kept") == want


def test_packing_merges_words_together(docs, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    whole, tokenizer, alone = Tokenizer.from_file(path), packing.WordTokenizer(path), []
    one = tokenizer._piece
    tokenizer._piece = lambda piece: alone.append(piece) or one(piece)
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 64)
    monkeypatch.setattr(packing, "MERGED_AT_ONCE", 50)
    texts = [t.encode() for _, t in pairs(docs)] + [
        b"", b" ", b" a\x00b\x1cc\x0bd ", "É'LL d's ŸŽ 12ab ªº ŉ İ ß é́ 日本 a\u00a0b\u2028c".encode(), b"<|endoftext|>x <|ENDOFTEXT|> <| a<b",
        b"\xff\xc3 \xe6\x97 x\xc3", b"x" * 300 + b" " + b"ab1" * 200, "é".encode() * 33
    ]
    for kind in (pa.binary(), pa.large_binary()):
        ids, at = tokenizer(pa.array([b"left out", *texts], kind).slice(1))
        assert len(at) == len(texts) + 1 and at[-1] == len(ids)
        for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
    assert len(tokenizer(pa.array([], pa.binary()))[0]) == 0
    # Only what is too long to be merged with others asks the library by itself.
    assert alone and all(len(x.decode()) > packing.PIECE_CHARS for x in alone)


def test_packing_round_trip(docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for d in (docs, odd):
        got = packing.pack_documents(d, path).collect()
        placed, want, have = defaultdict(list), Counter(), Counter()
        for r in got:
            placed[r.sequence_id].append((r.offset, r.length))
            have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        for i, t in pairs(d):
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
            for k, s in enumerate(range(0, len(ids), 2048)):
                part = ids[s : s + 2048]
                want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
        assert have == want
        for parts in placed.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    total = sum(r.length for r in packing.pack_documents(docs, path).collect())
    assert len({r.sequence_id for r in packing.pack_documents(docs, path).collect()}) <= 1.05 * total / 2048 + 2


def test_secrets_ledger_is_incremental(spark, odd):
    texts = [
        (1, 'Password: "hunter22"'), (2, "AKIA" + "Z" * 16 + " " + "0f" * 12), (3, 'Password: "hunter22"'),
        (4, "token=abc"), (5, None), (6, "secret=token: abcdefgh é AKIA")
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    first = secrets.table(secrets.scan(d.where("doc_id < 3")), "first")
    assert secrets.scan(d, first).count() == 3  # texts 4, 5 and 6; text 3 is known
    got = rows(secrets.secret_findings(d, first), "n_assign", "n_access", "n_hex", "spans")
    assert got[1] == got[3] == (1, 0, 0, "assign:0:19") and got[2] == (0, 1, 1, "access:0:20,hex:21:45")
    assert got[4] == got[5] == (0, 0, 0, "") and got[6][0] == 0
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert clean[1] == '[assign]"' and clean[2] == "[access] [hex]" and clean[4] == "token=abc" and clean[5] is None
    assert secrets.secret_findings(odd).count() == len(ODD)


def test_ledger_is_kept_and_long_texts_are_whole(spark, tmp_path):
    path = str(tmp_path / "ledger")
    versions = [("a", 1, "token=abcdef"), ("a", 2, "token=abcdefgh"), ("b", 1, "token=abcdef")]
    d = spark.createDataFrame(versions, "path string, version int, text string")
    first = secrets.keep_ledger(spark, path, d.where("version = 1"))
    assert first.count() == 1
    whole = secrets.keep_ledger(spark, path, d)
    assert whole.count() == 2 and secrets.keep_ledger(spark, path, d).count() == 2
    got = {(r.path, r.version): len(r._found) for r in secrets.findings(d, whole).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1}
    newer = secrets.RULES[:1] + (secrets.Rule("access", 2, "AKIA[A-Z]{2,}"),)
    assert secrets.keep_ledger(spark, path, d, newer).count() == 4  # both texts again, for the newer rule only

    long = "".join(f"é{i} token=secret{i:06d} AKIA{'Q' * 16} " for i in range(3000))
    found = secrets.secret_findings(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    base = [
        (m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"token=secret\d{6}", long)
    ] + [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIAQ+", long)]
    assert found.spans == ",".join(t for _, _, t in sorted(base)) and found.n_assign == found.n_access == 3000
    clean = secrets.redact(spark.createDataFrame([(1, long, "clash", "clash")], "doc_id long, text string, spans string, blob string")).first()
    assert clean.text == re.sub("AKIAQ+", "[access]", re.sub(r"token=secret\d{6}", "[assign]", long)) and clean.spans == clean.blob == "clash"


def test_mixing_meets_targets(spark, docs, odd):
    one = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (one.taken <= 3 * one["size"]).all()
    per = one.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), biggest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.biggest).all() and abs(per.target.sum() - one["size"].sum()) < 1
    two = mixing.mix_sources(docs).toPandas().set_index("doc_id").taken
    assert (one.set_index("doc_id").taken == two).all()
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_of_rows_without_or_with_one_id(spark):
    texts = [(None, "w " * (1 + i % 7), "a") for i in range(300)] + [(5, "v " * 9, "b")] * 100 + [(None, None, None), (6, "", "b")]
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    one = mixing.mix_sources(d).toPandas()
    assert len(one) == len(texts) and (one.copies <= 3).all()
    per = one.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 9).all()
    many = mixing.mixed_documents(d.withColumn("copies", F.lit("clash"))).toPandas()
    size = many.text.fillna("").str.split().str.len()
    assert list(many.columns) == ["doc_id", "text", "source", "copies"]
    for source, n in (("a", 7), ("b", 9)):
        target = one[one.source_size == sum(len((t or "").split()) for _, t, s in texts if s == source)].target.iloc[0]
        assert abs(size[many.source == source].sum() - target) <= n


def test_targets_reshare(spark):
    d = spark.createDataFrame([("sa", 10, 1), ("sb", 100, 1), ("sc", 1000, 1), ("t", 0, 1)], "skey string, source_size long, n long")
    got = {r.skey: r.target for r in mixing.targets(d).collect()}
    weight, left, level = {"sa": 5, "sb": 2, "sc": 1, "t": 5}, 1110.0, {}
    size = {"sa": 10, "sb": 100, "sc": 1000, "t": 0}
    while True:
        free = [s for s in size if s not in level]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            level[s] = 3 * size[s]
            left -= level[s]
    assert {**share, **level} == pytest.approx(got)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(2)
    x[50:120] = x[50]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [
        (20, [9.0] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [])
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    usable = df.select("vec_id", topk.integer_vector(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    for r in topk.top_k(usable, usable.where("vec_id % 20 = 0"), 10, block_rows=64, query_numbers=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = [*range(300), 20]
    whole = np.floor(1024 * np.vstack((x, np.full((1, 8), 9.0)))).astype(np.int64)
    for q in range(0, 300, 20):
        score = whole @ min((whole[k] for k in range(301) if ids[k] == q), key=list)  # id 20 comes twice
        want = sorted(((s, v) for v, s in zip(ids, score.tolist()) if v != q), key=lambda p: (-p[0], p[1]))[:10]
        assert got[q] == [(v, s) for s, v in want]
    assert topk.embedding_top_k(df.limit(0)).count() == 0
    assert topk.embedding_top_k(df.withColumns({"rank": F.lit(1), "score": F.lit("clash"), "x": F.lit(0)}), every=20).count() == 150


def test_line_rules_base(docs, labels, odd, alike):
    for d in (docs, odd, alike):
        got = Counter(
            tuple(r) for r in lines.quality_rules(d, labels).select(
                "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
            ).collect()
        )
        want = Counter()
        for i, t in pairs(d):
            w, places, repeat, seen, again = t.encode().split(), defaultdict(list), set(), set(), 0
            for s in range(len(w) - 7):
                places[tuple(w[s : s + 8])].append(s)
            for found in places.values():
                if len(found) > 1:
                    repeat.update(j for s in found for j in range(s, s + 8))
            for line in t.split("\n"):
                if line.encode().split():
                    again += line in seen
                    seen.add(line)
            want[
                i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), again, len(repeat),
                len(w) < 20 or 100 * len(repeat) > 30 * len(w)
            ] += 1
        assert got == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    crf = lines.LineCRF(rng.normal(size=3), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(14, 3)), np.array([0, 1, 6, 14])
    got = crf.viterbi(x, first)
    for a, b in zip(first[:-1], first[1:]):
        def value(path):
            return sum(y * (x[a + k] @ crf.weights) for k, y in enumerate(path)) + sum(crf.move[i, j] for i, j in zip(path, path[1:]))
        every = [[(n >> k) & 1 for k in range(b - a)] for n in range(1 << (b - a))]
        assert value(got[a:b].tolist()) == pytest.approx(max(map(value, every)))


def held_out_accuracy(spark, scores, column):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    p = scores(d, l).where("held_out").join(l, "doc_id").toPandas()
    return (p.predicted == p[column]).mean()


def test_classifiers_on_held_out_rows(spark):
    assert held_out_accuracy(spark, quality.quality_scores, "quality") > 0.95
    assert held_out_accuracy(spark, toxicity.toxicity_scores, "toxic") > 0.95


def test_classifiers_on_odd_input(labels, odd):
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        got = f(odd, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert f(odd.limit(0), labels).count() == 0
        assert f(odd, labels.limit(0)).count() == len(ODD)


def test_toxicity_with_few_labels(spark):
    texts = [(i, ("you stupid fool " if i % 3 == 0 else "a calm and kind text ") * (1 + i % 4)) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    train = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5]
    for n in (5, 39, 41):
        l = spark.createDataFrame([(i, int(i % 3 == 0)) for i in train[:n]], "doc_id long, toxic int")
        p = toxicity.toxicity_scores(d, l).toPandas()
        assert p.score.between(0, 1).all()
        if n > 5:
            assert (p.predicted == (p.doc_id % 3 == 0)).mean() > 0.9


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    score, y = rng.normal(size=9), rng.integers(0, 2, 9).astype(float)
    got = toxicity.Isotonic(score, y)(score)
    order = np.argsort(score)
    # The best non-decreasing fit is at each place the largest over starts of the least mean over ends.
    sorted_ = y[order]
    want = [max(min(sorted_[a : b + 1].mean() for b in range(k, 9)) for a in range(k + 1)) for k in range(9)]
    fit = toxicity.Isotonic(score, y)
    blocks = [
        float(v) for v, n in zip(
            fit.value,
            np.diff(np.searchsorted(score[order], [*((fit.at[1:] + fit.at[:-1]) / 2), np.inf], side="right"), prepend=0)
        ) for _ in range(n)
    ]
    assert (np.diff(got[order]) >= -1e-12).all() and len(blocks) == 9
    assert sorted(set(np.round(blocks, 9))) == sorted(set(np.round(want, 9)))


def test_first_tree_takes_the_best_split():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    model = toxicity.BoostedTrees(x, y, trees=1, depth=1, least=2.0)
    g, h = y.mean() - y, np.full(80, y.mean() * (1 - y.mean()))
    every = []
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            if h[low].sum() >= 2 and h[~low].sum() >= 2:
                every.append(sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1))
    got = model(x)
    sides = [got == v for v in np.unique(got)]
    assert sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in sides) - g.sum() ** 2 / (h.sum() + 1) == pytest.approx(max(every))
    for m in sides:
        assert got[m][0] == pytest.approx(model.base - 0.15 * g[m].sum() / (h[m].sum() + 1))


def test_risk_sums_are_the_loss_and_its_derivatives():
    rng = np.random.default_rng(5)
    x, w, e = rng.normal(size=(20, 3)), rng.normal(size=3), 1e-5
    loss = lambda v: np.log1p(np.exp(x @ v)).sum()
    got, unit = quality.risk_sums(x, w), np.eye(3) * e
    assert got[0] == pytest.approx(loss(w))
    assert got[1:4] == pytest.approx([(loss(w + u) - loss(w - u)) / (2 * e) for u in unit], rel=1e-5)
    assert got[4:].reshape(3, 3) == pytest.approx(
        np.array([(quality.risk_sums(x, w + u)[1:4] - quality.risk_sums(x, w - u)[1:4]) / (2 * e) for u in unit]),
        rel=1e-5
    )


def test_positive_unlabelled_risk_is_least():
    """Against a plain search: no small step from the fitted weights lowers the risk."""
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (60, 2)), np.vstack((rng.normal(1, 1, (40, 2)), rng.normal(-1, 1, (160, 2))))
    mean, scale = u.mean(0), u.std(0)
    xu, xp = quality.expand(u, mean, scale), quality.expand(p, mean, scale)
    model = quality.PUModel(p, mean, scale, lambda w: quality.risk_sums(xu, w), len(u), 0.1)
    loss = lambda z: np.logaddexp(0, z)
    risk = lambda w: 0.1 * loss(-(xp @ w)).mean() + max(0, loss(xu @ w).mean() - 0.1 * loss(xp @ w).mean()) + 5e-4 * w @ w
    here = risk(model.weights)
    assert all(risk(model.weights + s) >= here - 1e-6 for s in rng.normal(0, 0.02, (200, xu.shape[1])))
    assert (model(u[40:]) < 0.5).mean() > 0.8 and model(p).mean() > 3 * model(u[40:]).mean()


def test_empty_tables(odd, labels):
    none = odd.limit(0)
    assert near_duplicates.near_duplicates(none).count() == substrings.remove_repeated_words(none).count() == substrings.remove_repeated_bytes(none).count() == 0
    assert near_duplicates.near_duplicates(odd).count() == len(ODD)
    assert secrets.secret_findings(none).count() == lines.quality_rules(none, labels).count() == 0
    assert packing.pack_documents(none, registry.tokenizer_path()).count() == 0
