"""Operators on documents against plain Python, on hard small tables: nulls, empty and long texts, repeated rows, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
import test_near_texts
from furrow.llm import bpe, line_dedup, near_copies, packing, quality_model, quality_rules, queries, sharding, token_counts

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line that several documents share"
WORDS = "the of and rain wheat corn été münze price l'eau don't we're 12 3.5 日本".split()


def sample_rows(count=60):
    rng = random.Random(5)
    rows = []
    for i in range(count):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 14))) + rng.choice(["", ".", " !!", "\t"]) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  " + LINE.upper() if i % 2 else LINE)
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}", None))
    copy = rows[7][1]
    rows += [(100, copy, "en", "src0", 3), (101, copy + " rain", None, None, 0), (102, None, None, None, None), (103, "", "en", "src1", 0),
             (104, "word " * 30_000, "en", "src1", 5), (105, "x" * 20_000, "en", "src2", 5), (None, LINE + "\nown", "en", "src3", 1),
             (None, None, None, None, None), (7, copy, "en", "src3", 1), (7, copy, "en", "src3", 1), (106, "\n\n \n", "en", "src0", 4)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    names = ("__results", "__host", "__kept", "__doc", "__mark", "__n", "__slot", "__row", "mark", "State", "verdict_host", "drops_doc", "shard_slot", "text_",
             "score", "kept", "shard", "n_tokens", "kept_text", "fp", "component_id", "drops", "host", "n")
    df = spark.createDataFrame(sample_rows(), DDL).repartition(3)
    return df.withColumns({n: F.lit("clash") for n in names}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_measures_and_host_verdicts(docs, empty):
    def repeated(w):
        spans = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        seen = Counter(spans)
        return len({j for i, s in enumerate(spans) if seen[s] > 1 for j in range(i, i + 5)})

    expected = []
    for r in sample_rows():
        w, t = split(r[1]), r[1] or ""
        lines = [x for x in t.split("\n") if split(x)]
        expected.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(w)))
    rows = quality_rules.measured(docs)
    assert rows_of(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(expected, key=repr)
    judged = quality_rules.judged(rows)
    assert judged.count() == docs.count() and "lang" in judged.columns
    assert judged.where("kept IS NULL OR (base_failed AND kept)").count() == 0
    assert quality_rules.judged(quality_rules.measured(empty)).count() == 0


def test_bad_host_loses_its_good_documents(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, good if i % 20 == 0 else bad, "en", "junk", 0) for i in range(200)]
    rows += [(1000 + i, good, "en", f"fine{i % 5}", 0) for i in range(300)] + [(2000, good, "en", None, 0), (2001, bad, "en", "one-page", 0)]
    judged = quality_rules.judged(quality_rules.measured(spark.createDataFrame(rows, DDL)))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert kept == {1000 + i for i in range(300)} | {2000}
    rates = {r.host: r for r in quality_rules.host_verdicts(quality_rules.measured(spark.createDataFrame(rows, DDL))).collect()}
    assert 0 < rates["one-page"].rate_base < 1 and rates["junk"].rate_base > 0.9  # one document alone is drawn to the mean


def test_placement(spark, docs, empty):
    table = sharding.filled_table(sharding.SHARDS, sharding.SLOTS)
    shares = Counter(table)
    assert len(shares) == len(sharding.SHARDS) and max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.filled_table(sharding.SHARDS[:-1], sharding.SLOTS)
    assert sum(a != b for a, b in zip(table, fewer)) < 0.1 * len(table)  # about one share in 32 has to move
    expected = [(r[0], sharding.SHARDS[table[sharding.number("" if r[0] is None else str(r[0])) % sharding.SLOTS]]) for r in sample_rows()]
    placed = sharding.placed(docs, "doc_id")
    assert rows_of(placed, "doc_id", "shard") == sorted(expected, key=repr)
    assert "Python" not in placed._jdf.queryExecution().toString()
    assert sharding.placed(empty, "doc_id").count() == 0
    for shards, slots in (((), 7), (("a", "a"), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.filled_table(shards, slots)


def unigram():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(3, model.get_piece_size()) if not model.is_byte(i)]
    made = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never", split=False)
    return made


def test_token_counts(docs, empty):
    tokenizer = unigram()

    def expected(text):
        if not text:
            return 0
        text = " " + text  # the space in front
        made = tokenizer.encode(text)
        return sum(1 if i else len(text[a:b].encode()) for i, (a, b) in zip(made.ids, made.offsets))

    rows = token_counts.counted(docs, queries.PIECES)
    assert rows_of(rows, "doc_id", "n_tokens") == sorted([(r[0], expected(r[1])) for r in sample_rows()], key=repr)
    assert token_counts.counted(empty, queries.PIECES).count() == 0
    rng, count = random.Random(3), token_counts.load(queries.PIECES)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "th", "the", " ", "  ", "\n", "é", "日", "\U0001F600", "ing", "Z", "1"], k=rng.randint(1, 12)))
        assert count(text) == expected(text), repr(text)


@pytest.fixture(scope="module")
def library():
    import base64

    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_decoding(docs, empty, library):
    rows = bpe.digests(docs, queries.RANKS)
    expected = []
    for r in sample_rows():
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows_of(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert bpe.digests(empty, queries.RANKS).count() == 0
    made = bpe.decode(bpe.encode(docs, queries.RANKS).withColumn("ids", F.col("tokens.ids")), queries.RANKS)
    for r in made.select("text", "tokens", "decoded").collect():
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.tokens.offsets[-1] == len(raw) and len(r.tokens.offsets) == len(r.tokens.ids) + 1


def test_boundaries_on_random_text(library):
    rng, coder = random.Random(1), bpe.Encoder.load(queries.RANKS)
    parts = ["'", "s", "re", "ve", "ll", "l", "r", "e", "t", " ", "  ", "\n", "\t", "A", "é", "1", "½", "!", "…", "\xa0", "日本", "\u0301", "\U0001F600", "\x85", "\x1c"]
    cases = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)] + ["x" * 3000, "ab" * 300, " " * 300 + "a"]
    assert [x.tolist() for x in coder.encode(cases)] == [library.encode_ordinary(c) for c in cases]


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    tokenizer.encode_special_tokens = True
    rows = packing.packed(docs, queries.VOCABULARY, group=40).collect()
    made = defaultdict(list)
    for r in rows:
        made[r.doc_id].append(r)
    for doc_id, text in {(r[0], r[1]) for r in sample_rows() if r[0] is not None}:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        copies = sum(r[0] == doc_id for r in sample_rows())
        pieces = sorted(made[doc_id], key=lambda r: r.piece)[::copies]
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == 1024 for p in pieces[1:])
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in pieces)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))] and sum(x for _, x in parts) <= 1024
    assert packing.packed(empty, queries.VOCABULARY).count() == 0


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes, rooms, expected = rng.integers(1, 65, rng.integers(0, 80)), [], []
        for size in sorted(sizes.tolist(), reverse=True):
            fits = [room for room in rooms if room >= size]
            room = min(fits, default=64)
            if fits:
                rooms.remove(room)
            else:
                expected.append(1)
            rooms.append(room - size)
        assert len(set(packing.best_fit(sizes, 64)[0].tolist())) == len(expected)


@pytest.mark.parametrize("split", [3, line_dedup.SPLIT])
def test_line_dedup(docs, empty, split):
    held, texts = defaultdict(set), [(r[0], r[1] or "") for r in sample_rows()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    last = line_dedup.LAST_ID
    for i, t in texts:
        for line in t.split("\n"):
            held[key(line)].add(last if i is None else i)
    expected = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == (last if i is None else i)]
        expected.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    rows = line_dedup.deduplicated(docs, split=split)
    assert rows_of(rows, "doc_id", "kept_text", "n_lines", "n_dropped") == sorted(expected, key=repr)
    assert any(x[3] for x in expected) and line_dedup.deduplicated(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        hashed = line_dedup.PerfectHash.build(keys)
        assert sorted(hashed.find(keys).tolist()) == list(range(len(keys)))
        assert hashed.find(rng.integers(0, 2**64, 100, dtype=np.uint64)).max(initial=-1) < max(1, len(keys))


def simhash(text):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def components_of(rows):
    """(id, fingerprint, smallest reachable id) of (id, fingerprint) rows."""
    values = sorted({f for _, f in rows})
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [(i, f, least.get(top(f))) for i, f in rows]


def test_near_copies(docs, empty):
    expected = components_of([(r[0], simhash(r[1])) for r in sample_rows()])
    got = near_copies.judged(docs)
    assert rows_of(got, "doc_id", "fp", "component_id") == sorted([(i, near_copies.signed(f), c) for i, f, c in expected], key=repr)
    spread = near_copies.judged(docs, sent=0)  # labels joined by shuffle, hot fingerprints spread
    assert rows_of(spread, "doc_id", "fp", "component_id") == rows_of(got, "doc_id", "fp", "component_id")
    assert near_copies.judged(empty).count() == 0 == near_copies.judged(empty, sent=0).count()


@pytest.mark.parametrize("block", [8, near_copies.BLOCK])
def test_links_keep_every_component(spark, block):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, 1, 3}
    for base in list(values)[:12]:  # chains, and a dense group of one
        at = base
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                at ^= 1 << b
            values.add(at)
    values |= {12345 ^ 1 << a ^ 1 << b for a in range(10) for b in range(10)}
    rows = [(i, f) for i, f in enumerate(sorted(values))]
    df = spark.createDataFrame([(i, near_copies.signed(f)) for i, f in rows], "doc_id long, fp long")
    found = near_copies.links(df, block=block).collect()
    root = {near_copies.signed(f): near_copies.signed(f) for _, f in rows}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        root[top(a)] = top(b)
    groups = defaultdict(set)
    for i, f in rows:
        groups[top(near_copies.signed(f))].add(i)
    expected = defaultdict(set)
    for i, _, c in components_of(rows):
        expected[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_plan_thresholds_cover_the_distance():
    rng = random.Random(4)
    for rows in (10, 10**6, 10**11):
        parts = near_copies.plan([near_copies.signed(rng.getrandbits(64)) for _ in range(300)], rows)
        bits = [b for p in parts for b in p.bits]
        assert sum(p.threshold + 1 for p in parts) == near_copies.DISTANCE + 1 and len(bits) == len(set(bits))


def test_classifier(spark, docs, empty):
    rng = random.Random(8)
    good = lambda: ". ".join(" ".join(rng.choices(WORDS, k=9)) for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, good().upper().replace(" ", "!! ") if bad else good(), "en", "s", 100))
        labels.append((i, None if i % 50 == 49 else int(not bad), 0))
    labels += [(3, 1, 0), (None, 1, 0), (99_999, 0, 0)]
    both = spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_model.trained(*both)
    assert model == quality_model.trained(*both)
    scored = quality_model.scored(both[0], model).withColumn("held", quality_model.held_out()).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 50 and sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    flipped = both[1].withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_model.trained(both[0], flipped) == model  # held-out labels are not read
    hard = quality_model.scored(docs, model).collect()
    assert len(hard) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in hard)
    none = quality_model.trained(empty, both[1].limit(0))
    assert {r.score for r in quality_model.scored(both[0], none).collect()} == {0.5}
    assert quality_model.scored(empty, model).count() == 0


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(3)
    model = quality_model.Model(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, value = np.array([1, 4, 5, 8]), rng.normal(size=4)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(model.raw(index, value, np.array([0]))[0], 0.3 + model.weights[index] @ value + pairs)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for r in sample_rows(40) if r[0] is not None and r[0] != 7]
    rows += [(200 + i, "\n".join(" ".join(rng.choices(WORDS, k=12)) for _ in range(5)), "en", "src1", 9) for i in range(60)]
    rows += [(300 + i, rows[-1 - i][1], "fr", "src2", 9) for i in range(20)]
    for i, text in enumerate([r[1] for r in rows if r[0] is not None and 230 <= r[0] < 250]):  # one word edited, on a single line
        joined = text.split()
        joined[30] = f"edited{i}"
        rows.append((400 + i, " ".join(joined), "en", "src3", 9))
    folder = str(tmp_path)
    spark.createDataFrame(rows, DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (103, 105)), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    packed = queries.QUERIES["pipeline"](spark, folder).collect()
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        assert docs.columns == list(DDL.replace(" long", "").replace(" string", "").split(", "))
        seen[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = seen["line dedup"]
    holder = {}
    for i in sorted(before):
        for line in (before[i].text or "").split("\n"):
            holder.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), i)
    for i, r in before.items():
        lines = [x for x in (r.text or "").split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r").lower()) < 10 or holder[k] == i]
        assert after[i].text == "\n".join(lines) and after[i].n_chars == len(after[i].text)
    before, after = seen["SimHash near-dedup"]
    ids = sorted(before)
    groups = test_near_texts.components_of([(i, before[i].text) for i in ids])
    first = {}
    for i, group in zip(ids, groups):
        first.setdefault(group, i)
    edited = [i for i in ids if 400 <= i < 420]
    assert edited and not set(edited) & set(after)
    assert set(after) == set(first.values())
    assert {r.doc_id for r in packed} == set(after) and len(after) > 20
    assert set(seen["quality rules"][1]) <= set(seen["quality rules"][0]) <= {r[0] for r in rows}


def test_pipeline_stages_take_empty_tables_and_clashing_names(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name in ("line dedup", "SimHash near-dedup"):
            assert {r.kept for r in stage(spark, docs, folder).collect()} == {"clash"}
