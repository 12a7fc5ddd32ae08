"""Operators for training data on small fixtures: odd rows, ties, copies, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsgraph.llm import (
    chat_format,
    decontaminate,
    elias_fano,
    language_id,
    lm_score,
    near_dup,
    packing,
    quality_rules,
    sharding,
    token_files,
    url_filter,
)
from newsgraph.llm.catalog import tokenizer_path
from newsgraph.llm.tokens import text_encoder
from newsgraph.llm.words import find_words, raw_text
from newsgraph.session import shared_folder, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("row", "n", "node", "band", "words", "hashes", "number", "shard", "rule", "score", "id", "known")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        None, "", "  \n\t ", "one", "One", "a b c d", base, base, base.upper(), near, sentence(rng, 3000),
        "!!! ... 123", "x" * 5000, "\n".join(["same line here"] * 6 + ["", "other"]), "é́ \x1c \x85 　 ½ <|endoftext|> it's",
        sentence(rng, 60) + "\x00", "the cat", "the cat",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(k, t, ["en", "fr", None][k % 3], 1) for k, t in enumerate(texts)]
    rows += [(None, "no id here", "en", 1), (3, texts[3], "en", 1), (3, texts[3], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra int")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# Words ------------------------------------------------------------------------


@pytest.mark.parametrize("lower", [False, True])
def test_words_and_their_hashes(lower):
    texts = [t for t in odd_texts()] + ["y" * 3_000_000 + " z", "w " * 700_000]
    data, at = raw_text(pa.array(texts))
    words = find_words(data, at, lower)
    names = {}
    for k, text in enumerate(texts):
        text = (text or "").translate(FOLD) if lower else text or ""
        found = WORD.findall(text)
        mine = words.hashes[words.first[k] : words.first[k + 1]]
        assert len(found) == len(mine)
        for w, h in zip(found[:5000], mine):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_word_by_word_ids_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for plain in (False, True):
        tokenizer.encode_special_tokens = plain
        encode = text_encoder(tokenizer_path(), plain)
        rng = random.Random(1)
        alphabet = "aAbZé́ñß'.,!?#*$|<>_-12½ \n\t\x1c\x85　😀日"
        texts = [t or "" for t in odd_texts()] + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(400)]
        texts += ["<|startoftext|>it's, they'll. <|endoftext|>!", "Abc'd.", "ABC...'s", "été!! ÉTÉ,"]
        for text in texts:
            expected = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode(text), "<u4").tolist() == expected


# 1. Packing -------------------------------------------------------------------


def fewest(lengths, capacity):
    """The least number of sequences, by trying."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                left = list(rooms)
                left.remove(room)
                place(k + 1, [*left, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    fixed_some = 0
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_instance(collections.Counter(lengths), 20)
        fixed_some += bool(fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sorted([x for p, n in fixed.items() for x in p * n] + left) == sorted(lengths)
        assert sum(fixed.values()) + (fewest(left, 20) if left else 0) == fewest(lengths, 20)
    assert fixed_some > 100


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1.5, 4000).astype(int), 1, 300)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.packing_plan(histogram, 300)
    filled = collections.defaultdict(list)
    for k in range(len(plan["length"])):
        length = int(plan["length"][k])
        last = k + 1 == len(plan["length"]) or plan["length"][k + 1] != length
        end = histogram[length] if last else plan["first"][k + 1]
        for number in range(plan["first"][k], end):
            within = number - plan["first"][k]
            filled[plan["sequence"][k] + within // plan["each"][k]].append((plan["offset"][k] + within % plan["each"][k] * length, length))
    assert sum(map(len, filled.values())) == len(lengths)
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 300
    assert len(filled) <= 1.02 * -(-lengths.sum() // 300) + 1


def test_packed_documents(spark, odd):
    packed = packing.pack_documents(odd, tokenizer_path(), capacity=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = collections.Counter()
    for row in odd.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 64):
            raw = np.array(ids[at : at + 64], "<u4").tobytes()
            expected[(row["doc_id"], at // 64, at, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in packed) == expected
    filled = collections.defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64


# 2. URL filter ------------------------------------------------------------------


def test_url_verdicts(spark):
    urls = {
        1: None, 2: "", 3: "no scheme", 4: "http://A.Example.ORG/en/2?x", 5: "https://example.org/es/1", 6: "http://www.example.org/en/19",
        7: "http://badexample.org/es/", 8: "http://x.com/de/", 9: "http://x.com/fr/xxx-porn", 10: "http://x.net/xxx/1", 11: "http://x.net/xxxl",
        12: "http://x.net/free-slots", 13: "http://x.net/free-free", 14: "http://x.org", 15: "http://x.net/a#://y.com/de/", 16: "http://x.net/?FREE&Casino",
        17: "http://fr.com/de/#x", 18: "a\nb://C.org/q",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("terms", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[5][2:] == ("example.org/es/", "block") and got[6][2:] == ("example.org/en/1", "block")
    assert got[7][2:] == ("org/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert got[12][3] == "block" and got[13][3] == "allow" and got[16][3] == "block"
    assert got[14] == ("x.org", "", None, "allow") and got[15][:2] == ("x.net", "/a") and got[18][0] == "c.org"
    assert url_filter.filter_urls(df.filter("false")).count() == 0
    assert url_filter.filter_urls(df.union(df)).count() == 2 * len(urls)


# 3. Chat formatting ---------------------------------------------------------------


def test_conversations_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|end|>", "<|start|>", "</s>", "<\\/s>", "[INST]", "[\\\\/INST]", "<", "|", "\\", "\n", "a", "é", "<|text|>", "<<SYS>>", "<|again|>", "😀"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "<|text|>r\n"])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(12))]), 1))
    rows += [(None, None, "user", "x", 1), (99, 1, "user", "b", 1), (99, 1, "user", "a", 1), (99, 1, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    made = chat_format.format_conversations(df)
    read = made.select(
        "conv_id", chat_format.parse_turns(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted",
    ).collect()
    told = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        told[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert {r["conv_id"] for r in read} == set(told)
    for r in read:
        turns = [t[1:] for t in sorted(told[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        runs = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<|start|>") == r["formatted"].count("<|end|>") == runs
    assert chat_format.format_conversations(df.filter("false")).count() == 0


# 4. Decontamination -----------------------------------------------------------------


def hits_by_trying(documents, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = collections.defaultdict(set)
    for item, text in items:
        words = split(text)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    found = []
    for doc, text in documents:
        words, hit, held = split(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                own = windows.get(tuple(words[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    held |= own
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        found.append((doc, len(words), len(hit), len(held), digest, bool(hit)))
    return sorted(found, key=repr)


def test_contaminated_words(spark, odd):
    rng = random.Random(9)
    passages = [sentence(rng, n) for n in (1, 3, 9, 10, 11, 30, 30)]
    items = [(k, p) for k, p in enumerate(passages)] + [(100, passages[5]), (100, passages[5]), (101, None), (102, " ,. "), (103, passages[2] + "!")]
    documents = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for k in range(40):
        parts = [sentence(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(passages).split()
            a = rng.randint(0, max(0, len(words) - 12))
            parts += [" ".join(words[a : a + rng.randint(5, 25)]).upper().replace("É", "é").replace("Ü", "ü"), sentence(rng, rng.randint(0, 4))]
        documents.append((1000 + k, ", ".join(parts)))
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.judge_documents(docs, bench).collect()), key=repr)
    expected = hits_by_trying(documents, items)
    assert got == expected
    assert 5 < sum(r[-1] for r in expected) < len(expected)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in expected)
    assert {r[-1] for r in decontaminate.judge_documents(docs, bench.filter("false")).collect()} == {False}
    assert decontaminate.judge_documents(docs.filter("false"), bench).count() == 0


# 5. Near-duplicates --------------------------------------------------------------


def components_by_trying(documents):
    sets = {}
    for doc, text in documents:
        words = WORD.findall((text or "").translate(FOLD))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        sets[doc] = grams or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("large, block", [(32, 256), (1, 3)])
def test_near_duplicates(spark, odd, monkeypatch, large, block):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(4)
    documents = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").filter("doc_id IS NOT NULL").distinct().collect()]
    number = 500
    for _ in range(12):
        base = sentence(rng, rng.choice([4, 30, 100, 250])).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = sentence(rng, 1)
            documents.append((number, " ".join(copy)))
            number += 1
    base = sentence(rng, 90).split()
    for k in range(60):  # a large group, some of it just out of reach of the rest
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = sentence(rng, 1)
        documents.append((number, " ".join(copy)))
        number += 1
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("node", F.lit(1))
    made = near_dup.near_duplicates(docs)
    assert by_id(made, "n_shingles", "component_id", "kept") == components_by_trying(documents)
    kept = near_dup.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in components_by_trying(documents).items() if v[2])


def test_near_duplicates_of_odd_rows(spark, odd):
    made = near_dup.near_duplicates(odd).collect()
    assert len(made) == odd.count()
    nameless = next(r for r in made if r["doc_id"] is None)
    assert nameless["kept"] and nameless["component_id"] is None
    assert [r["component_id"] for r in made if r["doc_id"] in (0, 1, 2)] == [0, 1, 2]
    assert near_dup.near_duplicates(odd.filter("false")).count() == 0


def kept_rows(spark, rows):
    """Sorted rows that stay of ``(doc_id, text)``."""
    made = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_rows_go_by_id_and_text(spark):
    rng = random.Random(11)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    # A null id on a copy and on texts of its own; id 5 on a copy of 2, on a text of its own, and first of a group.
    rows = [(1, a), (None, a), (None, b), (None, c), (2, d), (5, d), (5, e), (7, e), (5, "own text " + c[::-1])]
    left = [(1, a), (None, b), (None, c), (2, d), (5, e), (5, "own text " + c[::-1])]
    assert kept_rows(spark, rows + [(None, b)]) == sorted(left, key=repr)


# 6. Sharding -----------------------------------------------------------------------


def test_shards(spark, odd):
    made = sharding.shard_documents(odd, [1.0] * 5)
    rows = sharding.with_slots(made, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.shard_documents(many, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] - 10000) < 500 and abs(counts[0] - 5000) < 400
    assert sharding.with_slots(sharding.shard_documents(odd.filter("false"), [1.0]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, [1.0, 0.0])


# 7. Language ------------------------------------------------------------------------


def test_languages(spark, odd):
    rng = random.Random(7)
    kinds = {"aa": "abcde ", "bb": "fghijé ", "cc": "klmno "}
    rows = []
    for k in range(240):
        lang = list(kinds)[k % 3]
        rows.append((k, "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(20, 300))) + "a", lang))
    rows += [(900, None, "aa"), (901, "12 !", "aa"), (902, "", None), (903, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = by_id(language_id.identify(docs), "held_out", "lang_pred", "score")
    assert all(made[k][1] == lang for k, _, lang in rows[:240])
    assert made[900][1:] == made[901][1:] == made[902][1:] == ("und", 0.0)
    assert all(0 <= v[2] <= 1 for v in made.values())
    assert all(v[0] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in made.items())
    kept = language_id.keep_identified(odd, 0.0)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert language_id.identify(odd.filter("false")).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_kernel_is_that_of_n_gram_sets():
    texts = ["abcab", "bca", "", "ABC", "zzzzzz"]
    present = next(language_id.gram_batches(pa.array(texts)))[2]
    grams = [{t.lower()[k : k + n] for n in range(1, 5) for k in range(len(t) - n + 1)} for t in texts]
    kernel = language_id.kernel_rows(present, present)
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            expected = len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0
            assert kernel[i, j] == pytest.approx(expected, abs=1e-6)


# 8. Quality ---------------------------------------------------------------------------


def statistics_by_trying(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_and_verdicts(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(None, 1), (6, None)], "doc_id long, quality int")
    made = quality_rules.judge_documents(odd, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect()}
    assert len(made) == odd.count()
    for r in made:
        expected = statistics_by_trying(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(odd, labels.filter("false"))
    assert kept.columns == odd.columns
    assert quality_rules.judge_documents(odd.filter("false"), labels).count() == 0


def test_rules_are_learned_and_become_expressions(spark):
    rng = np.random.default_rng(1)
    n = 3000
    values = {name: rng.random(n) for name in quality_rules._RATIOS}
    bad = (values["symbols_per_word"] > 0.8) | ((values["upper_per_char"] > 0.7) & (values["word_length"] <= 0.4))
    rules = quality_rules.learn_rules(values, bad)
    hit = np.zeros(n, bool)
    for rule in rules:
        hit |= quality_rules._covered(rule, values, n)
    assert (hit == bad).mean() > 0.98
    assert quality_rules.learn_rules(values, np.zeros(n, bool)) == []
    frame = spark.createDataFrame([(10, 100, 9, 0, 0, 1, 0, 0, 0, 10)], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_digits long, n_distinct long")
    assert frame.select(quality_rules.rule_number(rules).alias("k")).first()["k"] >= 1
    assert frame.select(quality_rules.rule_number([]).alias("k")).first()["k"] == 0


# 9. Language model -----------------------------------------------------------------------


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (7, 8), (1000, 1 << 12), (5000, 1 << 40), (3000, (1 << 63) - 1)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        held = elias_fano.EliasFano(values, elias_fano.MappedFile())
        asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, top], np.uint64)])
        place, hit = held.successor(asked)
        assert (place == np.searchsorted(values, asked)).all()
        assert (hit == np.isin(asked, values)).all()
    assert elias_fano.EliasFano(np.unique(rng.integers(0, 1 << 40, 100_000, dtype=np.uint64)), elias_fano.MappedFile()).bytes() < 100_000 * 5


def scores_by_trying(documents):
    train = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 != 2
    tokens = lambda t: [*WORD.findall((t or "").translate(FOLD)), None]
    one, two, begin = collections.Counter(), collections.Counter(), 0
    for doc, text in documents:
        if train(doc):
            ts = tokens(text)
            one.update(ts)
            two.update(zip(["", *ts], ts))
            begin += 1
    total, distinct = sum(one.values()), len(one)
    found = []
    for doc, text in documents:
        ts, base, score = tokens(text), 0.0, 0.0
        for before, t in zip(["", *ts], ts):
            p = (one[t] + 1) / (total + distinct + 1)
            base += np.log10(p)
            context = begin if before == "" else one[before]
            score += np.log10((two[(before, t)] + lm_score.MU * p) / (context + lm_score.MU))
        found.append((doc, not train(doc), len(ts), sum(one[t] > 0 for t in ts), total, base, score))
    return sorted(found, key=repr)


@pytest.mark.parametrize("shards", [1, 9])
def test_scores(spark, odd, shards):
    documents = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rng = random.Random(6)
    documents += [(k, " ".join(rng.choice(["the", "of", "a", "b", "c"]) for _ in range(30))) for k in range(100, 160)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("score", F.lit(1))
    got = sorted((tuple(r) for r in lm_score.score_documents(docs, shards).collect()), key=repr)
    expected = scores_by_trying(documents)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] == pytest.approx(b[6], abs=1e-3 * b[2])
    assert lm_score.score_documents(docs.filter("false")).count() == 0
    held_out = docs.filter("doc_id IS NOT NULL AND crc32(cast(doc_id as string)) % 7 = 2")
    assert {r["train_tokens"] for r in lm_score.score_documents(held_out).collect()} == {0}


# 10. Token counts ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_token_counts(spark, odd, block):
    from uuid import uuid4

    from tokenizers import Tokenizer

    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    docs = odd.filter("doc_id <> 10 AND doc_id <> 12") if block == 1 else odd
    listed = stored(token_files.write_token_files(docs, folder, tokenizer_path()), "listed")
    counted = token_files.document_lengths(token_files.scan_blocks(token_files.token_blocks(spark, folder, block), folder))
    rows = listed.join(counted, ["file", "place"], "left").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
    empty = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    assert stored(token_files.write_token_files(docs.filter("false"), empty, tokenizer_path()), "listed").count() == 0
    assert token_files.document_lengths(token_files.scan_blocks(token_files.token_blocks(spark, empty), empty)).count() == 0
