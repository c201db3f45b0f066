"""Each operator on texts against brute force, on hard rows and on empty tables."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nilas.llm import line_dedup, mixing, ngram_join, packing, sharding, suffix_index, token_count, toxicity
from nilas.llm.bpe import TokenCounter
from nilas.llm.queries import vocabulary
from tests.llm.hard import LONG, SCHEMA, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- token counts


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("texts", [["", " ", "  a", "a  b", "a\n b", "a \n  b ", "\n\n\na", "a   ", "<|endoftext|>x <|endoftext|>", "aaaaaaa" * 50, "it's we'll", "é漢 \x1c\x85 z", "1234,56 a.b"]])
def test_counts_equal_the_library(texts):
    ref = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(vocabulary("byte_bpe_50k.json")).count(texts) == ref
    assert TokenCounter(vocabulary("byte_bpe_50k.json"), remember=2).count(texts) == ref


def test_token_count_of_hard_rows(hard, empty):
    t = library("byte_bpe_50k.json")
    got = Counter(tuple(r) for r in token_count.count_tokens(hard, vocabulary("byte_bpe_50k.json"), rows=4).collect())
    ref = Counter()
    for i, text, *_ in rows():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        ref[(i, len((text or "").encode()), n, n > 512)] += 1
    assert got == ref
    assert token_count.count_tokens(empty, vocabulary("byte_bpe_50k.json")).count() == 0


# --- packing


def check_packing(found, texts):
    t = library("word_bpe_49k.json")
    ref = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, lo in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[lo : lo + 4096], dtype="<u4")
            ref[(i, n, lo, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == ref
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), -(-sum(k[3] * n for k, n in ref.items()) // 4096)


def test_packing(spark, hard, empty):
    check_packing(packing.pack(hard, vocabulary("word_bpe_49k.json")).collect(), [(r[0], r[1]) for r in rows()])
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used, least = check_packing(packing.pack(docs, vocabulary("word_bpe_49k.json")).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= least + 1


def test_word_ids_with_little_memory():
    texts = ["é.a", "İ. x", "a²½b ﬁ Σς ΑΣ.", "it's 'sx", "é.", "x\x1fy", "<|startoftext|>a", "漢字a,b", " ".join(f"q{i}z{i}" for i in range(300))]
    ref = [e.ids for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    w = packing.WordIds(vocabulary("word_bpe_49k.json"), remember=5)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in w.ids(texts)] == ref


def test_word_ids_are_remembered_across_tasks(monkeypatch):
    path, texts = vocabulary("word_bpe_49k.json"), ["red foxes, two of them", "it's a x9-quartz day"]
    first, asked = packing.word_ids(path).ids(texts), []
    compute = packing.WordIds.encode
    monkeypatch.setattr(packing.word_ids(path).units, "compute", lambda units: asked.extend(units) or compute(packing.word_ids(path), units))
    assert packing.word_ids(path).ids(texts) == first == packing.WordIds(path).ids(texts) and not asked
    packing.word_ids(path).ids(["red quartzes"])
    assert asked == ["quartzes"]


def test_ids_and_counts_around_every_character():
    rng = random.Random(7)
    chars = [chr(c) for c in range(0x323B0) if not 0xD800 <= c < 0xE000]
    odd = [" ", "  ", "\n", "'", "'s", "a", "B", "1", "²", ".", "é", "글", "漢", "\u3000", "\x1c", "<|endoftext|>", "İ", "ǅ", "\u0301", "😀", "\U00014081", "\ua7f1", "ª", "Ⅷ", "_"]
    texts = ["글" + c + "a" for c in chars] + ["".join(rng.choice(odd) if rng.random() < 0.8 else rng.choice(chars) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    ref = [np.array(e.ids, "<u4").tobytes() for e in library("word_bpe_49k.json").encode_batch_fast(texts, add_special_tokens=False)]
    assert packing.WordIds(vocabulary("word_bpe_49k.json")).ids(texts) == ref
    assert TokenCounter(vocabulary("byte_bpe_50k.json")).count(texts) == [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch_fast(texts, add_special_tokens=False)]


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    for cap in (10, 64, 256):
        counts = Counter(rng.randint(1, cap) for _ in range(400))
        used = Counter()
        for parts, times in packing.plan_packing(counts, cap):
            assert sum(parts) <= cap
            for p in parts:
                used[p] += times
        assert used == counts


# --- repeated passages


def brute_spans(texts, width):
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if seen[t[a : a + width]] > 1:
                gone[a : a + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[(i, len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), kept)] += 1
    return out


def found_spans(df, **options):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_index.remove_repeats(df, **options).collect())


@pytest.mark.parametrize("width", [40, 100])
def test_suffix_index(spark, width):
    rng = random.Random(width)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(50, 200))) for _ in range(8)]
    texts = []
    for i in range(120):
        pick = lambda: rng.choice([rng.choice(parts)[rng.randint(0, 20) :], "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 90)))])
        texts.append((i, "".join(pick() for _ in range(rng.randint(0, 6)))))
    texts += [(500, "a" * 300), (501, "ab" * 200), (502, ""), (503, texts[5][1]), (504, texts[5][1] + "x"), (500, "a" * 300)]
    df = spark.createDataFrame([*texts, (505, None)], "doc_id long, text string")
    assert found_spans(df, length=width, gram=16) == brute_spans([(i, t.encode()) for i, t in texts] + [(505, b"")], width)


def test_suffix_index_of_hard_rows(hard, empty):
    assert found_spans(hard) == brute_spans([(i, (t or "").encode()) for i, t, *_ in rows()], 400)
    assert suffix_index.remove_repeats(empty).count() == 0


def test_suffix_index_tells_rows_of_one_id_apart(spark):
    a, b = ("".join(hashlib.md5(f"{i}:{j}".encode()).hexdigest() for j in range(13)) for i in (48337, 107172))
    texts = [(1, a), (1, b), (2, a)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    assert found_spans(df) == brute_spans([(i, t.encode()) for i, t in texts], 400)


def test_family_finds_every_seed(spark, monkeypatch):
    rng = random.Random(8)
    rows_ = [(rng.randint(-30, 30), rng.randint(0, 9), rng.randint(-9, 9), rng.randint(0, 2), i, i % 3) for i in range(1500)]
    df = spark.createDataFrame(rows_, "a long, b long, head long, run long, k1 long, k2 int").withColumn("head", F.xxhash64("a", "b", "head")).repartition(3).cache()
    want = {r["head"]: r["differ"] for r in df.groupBy("a", "b", "head").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("differ")).where("n > 1").collect()}
    sizes = []
    add = suffix_index.IndexFamily.add

    def watched(self, rows):
        add(self, rows)
        sizes.append([x is not None for x in self.levels])
        for level in filter(None, self.levels):
            parts = {}
            for r in level.select("*", F.input_file_name().alias("file")).collect():
                parts.setdefault(r["file"], []).append(tuple(x % 2**64 for x in (r["a"], r["b"], r["head"])))
            assert all(x == sorted(set(x)) for x in parts.values())  # in the order of their bytes

    monkeypatch.setattr(suffix_index.IndexFamily, "add", watched)
    for least in (1 << 20, 100):
        sizes.clear()
        assert {r["head"]: r["differ"] for r in suffix_index.indexed(df, part_rows=200, least_batch=least).matches().collect()} == want
        assert sizes == [[bool(i >> k & 1) for k in range(i.bit_length())] for i in range(1, len(sizes) + 1)]
    assert len(sizes) == 5 and suffix_index.indexed(df.limit(0)).matches().count() == 0


def test_long_texts_are_cut_at_runs():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(3 * suffix_index.PIECE)) * 2
    whole = [np.concatenate(c) for c in zip(*suffix_index.suffixes([text], 400, 64), strict=True)]
    assert whole[2][0] == 0 and whole[3][-1] == len(text) - 400
    assert (whole[2][1:] == whole[3][:-1] + 1).all()  # every window is in one run
    half = len(text) // 2
    first = {tuple(x) for x in zip(whole[1], whole[5], strict=True) if 1000 < x[0] < half - 1000}
    second = {(p - half, r) for p, r in zip(whole[1], whole[5], strict=True) if half + 1000 < p < len(text) - 1000}
    assert first == second


# --- lines


def test_line_dedup(spark, hard, empty):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    texts = [(r[0], r[1]) for r in rows()] + [(100 + i, f"x{i}\n \tCommon Ä Line\r\n\n\nend{i}") for i in range(10)] + [(200 + i, "Nine\nnine") for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n_lines": F.lit("clash"), "n_dropped": F.lit(1)})
    seen = Counter(k for _, t in texts for k in {x.strip(space).translate(lower) for x in (t or "").split("\n")} if k)
    ref = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if seen[x.strip(space).translate(lower)] < 10]
        ref[(i, "\n".join(stay), len(lines), len(lines) - len(stay))] += 1
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()) == ref
    assert sum(r[3] for r in ref.elements()) >= 10
    assert line_dedup.dedup_lines(empty).columns == [*[c for c in empty.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(hard).count() == len(rows())


# --- sharding


def test_shards_are_even_and_stable(hard, empty):
    a, b = sharding.fill_table([f"s{i}" for i in range(10)], 1009), sharding.fill_table([f"s{i}" for i in range(9)], 1009)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 9) < 250
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 1000)
    got = sharding.place(hard).collect()
    ref = Counter((i, int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 65_537) for i, *_ in rows())
    assert Counter((r["doc_id"], r["slot"]) for r in got) == ref
    assert all(0 <= r["shard"] < 64 for r in got)
    assert sharding.place(empty).count() == 0


# --- mixing


def test_sainte_lague(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 1000):
        votes = [rng.choice([0.0, rng.random() * 10, rng.random() * 1000]) for _ in range(12)] + [5.0, 5.0]
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "name int, votes double, seats long")
        got = {r["name"]: r["quota"] for r in mixing.apportion(df, [], "name", "votes", "seats").collect()}
        ref = [0] * len(votes)
        for _ in range(seats):
            ref[max(range(len(votes)), key=lambda i: (votes[i] / (2 * ref[i] + 1), -i))] += 1
        assert got == dict(enumerate(ref))


def test_mixing(spark, hard, empty):
    rng = random.Random(3)
    texts = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    texts += [(1000, None, "tiny"), (1001, "x y z", "tiny"), (1001, "x y z", "tiny")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, shard_words=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.coalesce(1), shard_words=2000).collect()))
    assert len(got) == len(texts)
    size = Counter()
    for _, t, s in texts:
        size[s] += len((t or "").split())
    names = sorted(x for x in size if x is not None) + [None]
    weight = dict(zip(names, [5, 2, 1] * 3, strict=False))
    total, target = sum(size.values()), dict.fromkeys(names, 0.0)
    open_ = set(names)
    while True:  # shares stop at three times the size; the excess goes round again
        rest = total - sum(3 * size[s] for s in names if s not in open_)
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3.0 * size[s] for s in names}
        over = {s for s in open_ if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        open_ -= over
    taken, source = Counter(), {i: s for i, _, s in texts}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 12
    assert mixing.mix(hard).count() == len(rows()) and mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(hard.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


# --- n-gram Jaccard


def brute_links(texts, threshold=0.8):
    sets = []
    for _, t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def least_reached(ids, links):
    out = []
    for i in range(len(ids)):
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append(min(ids[j] for j in seen))
    return out


def near_copies(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
        else:
            words = [f"v{rng.randint(0, 500)}" for _ in range(rng.randint(3, 120))]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("tile_rows", [512, 20])
def test_ngram_join(spark, tile_rows):
    texts = [*near_copies(300, 5), (900, None), (901, ""), (902, "A b"), (903, "a B")]
    got = {r["doc_id"]: r for r in ngram_join.similar(spark.createDataFrame(texts, "doc_id long, text string"), tile_rows=tile_rows).collect()}
    links = brute_links(texts)
    classes = least_reached([i for i, _ in texts], links)
    for (i, _), mine, c in zip(texts, links, classes, strict=True):
        assert (got[i]["class_id"], got[i]["n_links"], got[i]["kept"]) == (c, len(mine), c == i)
    assert sum(map(len, links)) > 100


def test_ngram_join_of_hard_rows(hard, empty):
    got = ngram_join.similar(hard).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"] and by_id[1]["n_links"] >= 3
    assert by_id[4]["n_links"] == by_id[5]["n_links"] == 0
    assert ngram_join.similar(empty).count() == 0


def test_posterior_bounds_grow():
    least = ngram_join.least_matches(0.8, 1e-6, 16, 128)
    assert list(least) == sorted(least) and least[0] >= 1 and least[-1] < 0.8 * 128


# --- toxicity


def test_toxicity(spark, hard, empty):
    rng = random.Random(6)
    plain = lambda: " ".join(f"word{rng.randint(0, 80)}" for _ in range(rng.randint(20, 200)))
    docs, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = plain()
        if bad:
            text += " " + rng.choice(["grumblefink", "Grumb1efink", "snarkwart", "snаrkwart", "blorgish"]) + " " + plain()
        docs.append((i, text))
        labels.append((i, int(bad)))
    labels += [(0, None), (None, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(d, y, train=F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in toxicity.score(d, lexicon).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    right = [got[i]["predicted"] == t for i, t in labels if i is not None and t is not None and i % 2]
    assert sum(right) / len(right) > 0.97
    assert toxicity.score(hard, lexicon).count() == len(rows()) and toxicity.score(empty, lexicon).count() == 0
    nothing = toxicity.learn(d, y.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(d, nothing).collect()} == {0}


def test_exception_phrases_and_folding():
    x = toxicity.Lexicon({" trash": 3.0, " idiot ": 4.0}, ("trash can",), (-1.0, 2.0, 0.0, 0.0))
    m = x.matcher()
    found = lambda t: [e for _, e in m(toxicity.fold(t))]
    assert found("the Trash can") == [] and found("the trash cat") == [" trash"] and found("an 1D10T!") == [" idiot "] and found("idiotic") == []
    assert found("trash trash can") == [" trash"] and toxicity.fold("ＡВс") == " abc "


def plain_score(lexicon, text):
    """Score of a text by searching every entry and phrase at every word."""
    t = toxicity.fold(text or "")
    starts = [i for i, c in enumerate(t) if c == " "]
    spans = [(i + 1, i + 1 + len(p)) for p in lexicon.phrases for i in starts if t.startswith(f" {p}", i)]
    hits = [(i + 1, e) for e in lexicon.entries for i in starts if t.startswith(e, i)]
    weight = sum(lexicon.entries[e] for a, e in hits if not any(lo <= a and a + len(e.rstrip()) <= hi for lo, hi in spans))
    words = len(t.split())
    x = [1.0, float(weight > 0), np.log1p(weight), np.log1p(100 * weight / ((words + 1 if words else 1) + 9))]
    return 1 / (1 + np.exp(-np.clip(np.dot(lexicon.model, x), -30, 30)))


def test_scores_equal_a_plain_search(spark, hard):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    lexicon = toxicity.learn(docs, labels, train=train)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, lexicon).collect()}
    assert lexicon.entries and len(got) == len(texts)
    for i, t in texts.items():
        want = plain_score(lexicon, t)
        assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] == (want >= 0.5)
    odd = toxicity.score(hard, lexicon, keep=("text", "score")).collect()
    assert all(r["score"] == pytest.approx(plain_score(lexicon, r["_k_text"]), abs=1e-9) and r["_k_score"] == 0.5 for r in odd)
    # Neither held-out labels nor lang and source move a score; ids only say which labels are held out.
    turned = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    other = toxicity.learn(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned, train=train)
    assert (other.entries, other.phrases, other.model) == (lexicon.entries, lexicon.phrases, lexicon.model)
    moved = toxicity.learn(docs.withColumn("doc_id", F.col("doc_id") + 7_000_000), labels.where(train).withColumn("doc_id", F.col("doc_id") + 7_000_000))
    assert (moved.entries, moved.phrases) == (lexicon.entries, lexicon.phrases) and moved.model == pytest.approx(lexicon.model, rel=1e-6)
    few = toxicity.learn(docs.union(docs.withColumn("text", F.concat("text", F.lit(" more")))), labels, most_labelled=50)
    assert len(few.model) == 4


def test_hard_rows_are_hard():
    assert len(LONG) > 200_000 and json.dumps(rows())
