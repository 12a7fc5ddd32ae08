"""Conversation repair, line deduplication and token alignment against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.llm import alignment, auction, line_dedup, turn_repair
from newsgraph.llm.catalog import BYTE_TOKENIZER, PIECE_TOKENIZER, tokenizer_path
from newsgraph.session import Scratch, shared_folder

SPACES = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("row", "part", "head", "sign", "code", "place", "batch", "h1", "text_hash", "links", "pairs", "count", "dropped")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def with_clashes(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


# Cheapest edits ---------------------------------------------------------------


def edits_by_trying(signs):
    """The least (cost, audit) over every way to edit a few rows."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None

    def ways(sign):
        role, fault = auction.role_of(sign), auction.fault_of(sign)
        yield 4, "D", ""
        if fault in (auction.OK, auction.CUT):
            more = 3 if fault == auction.CUT else 0
            yield more, "K", role
            yield 3 + more, "R", "u"
            yield 3 + more, "R", "a"

    for rows in itertools.product(*[list(ways(s)) for s in signs]):
        for added in itertools.product(gaps, repeat=len(signs) + 1):
            roles = audit = ""
            for k, gap in enumerate(added):
                roles, audit = roles + "".join(gap), audit + "I" * len(gap)
                if k < len(rows):
                    roles, audit = roles + rows[k][2], audit + rows[k][1]
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(r[0] for r in rows) + 3 * sum(map(len, added))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_auction_finds_the_least_of_all_edits():
    rng = random.Random(3)
    cases = ["", *"ABCDEFGHIMNO"]
    cases += ["".join(rng.choice("AABBCCDEJMNOP") for _ in range(rng.choice([2, 2, 3]))) for _ in range(40)]
    for signs in cases:
        cost, edits = auction.cheapest_edits(signs)
        assert (cost, "".join(e[0] for e in edits)) == edits_by_trying(signs), signs


def test_prices_hold_on_every_arc_and_are_tight_along_the_path():
    rng = random.Random(4)
    for _ in range(50):
        rows = "".join(rng.choice("ABCDEJMNOP") for _ in range(auction.BLOCK))
        exits = tuple(rng.randint(0, 9) for _ in auction.STATES)
        price = auction.settle(rows, exits, False)
        for r, s in itertools.product(range(len(rows)), auction.STATES):
            for _, _, cost, to in auction.arcs(rows, (r, s)):
                assert price[r, s] <= cost + price[to]


def cost_by_steps(signs):
    """Least cost alone, state by state."""
    far = 10**9
    costs = [0, far, far, far]

    def opened(c):
        user = min(c[2], *[c[s] + 3 for s in (0, 1, 3)])
        return [c[0], c[1], user, min(c[3], user + 3)]

    for sign in signs:
        c, role, fault = opened(costs), auction.role_of(sign), auction.fault_of(sign)
        costs = [x + 4 for x in c]
        if fault in (auction.OK, auction.CUT):
            more = 3 if fault == auction.CUT else 0
            for state in auction.STATES:
                for new in "sua":
                    if (state, new) in auction.AFTER and (new == role or new != "s"):
                        after = auction.AFTER[state, new]
                        costs[after] = min(costs[after], c[state] + more + (0 if new == role else 3))
    c = opened(costs)
    return min(c[0], c[3])


def test_long_conversations_cost_what_a_step_by_step_search_finds():
    rng = random.Random(5)
    for n in (17, 400, 30_000):
        signs = "".join(rng.choice("BBBBCCCCACDEJMNOP") for _ in range(n))
        cost, edits = auction.cheapest_edits(signs)
        assert cost == cost_by_steps(signs)
        assert sum(e[0] != "I" for e in edits) == n


# Conversations ----------------------------------------------------------------


def repair_by_hand(rows):
    """Reports and lines of damaged rows, by conversation."""
    made = {}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signs, counts = set(), "", collections.Counter()
        for _, role, text in held:
            bare = text.strip(SPACES)
            fault = (
                auction.BLANK if not bare
                else auction.DUPLICATE if (role, text) in seen
                else auction.CUT if bare[-1] not in ".!?" else auction.OK
            )
            seen.add((role, text))
            counts[fault] += 1
            signs += auction.symbol(role[:1], fault)
        cost, edits = auction.cheapest_edits(signs)
        lines, k = [], 0
        for letter, role in edits:
            name = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                lines.append(f"{name}:")
                continue
            if letter in "KR":
                lines.append(f"{name if letter == 'R' else held[k][1]}:{held[k][2]}")
            k += 1
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        made[conv] = (
            gaps, counts[auction.BLANK], counts[auction.DUPLICATE], counts[auction.CUT], illegal, cost,
            "".join(e[0] for e in edits), sha("\n".join(lines)) if lines else None,
        )
    return made


def repaired(spark, df):
    with Scratch(spark) as scratch:
        made = turn_repair.repair_conversations(df, scratch)
        digests = {r["conv_id"]: r["digest"] for r in turn_repair.turn_digests(made.turns).collect()}
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return {r["conv_id"]: (*[r[c] for c in names], digests.get(r["conv_id"])) for r in made.reports.collect()}


CONVERSATION = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(6)
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."),
        (2, None, "user", None), (2, None, None, "Who?"), (2, 5, "user", "Who?"), (2, 5, "user", "Who?"),
        (3, 1, "tool", "x"), (4, 2, "", ""), (4, 9, "assistant", " \t\x0b"), (5, 3, "user", "q" * 100_000),
        (None, 1, "user", "No id."), (None, None, "assistant", "None."), (None, 1, "user", "No id."),
        (6, 1, "user", " "), (6, 2, "assistant", "é!　"), (6, 2, "assistant", "É!"), (6, 2, "Assistant", "A."),
    ]
    texts = ["Good.", "Well!", "no stop", "", "  ", "What? ", "same."]
    for conv in range(10, 40):
        rows += [(conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, "bot"]), rng.choice(texts)) for _ in range(rng.randint(1, 12))]
    return rows


def test_repaired_conversations(spark):
    rows = odd_conversations()
    df = with_clashes(spark.createDataFrame(rows, CONVERSATION))
    assert repaired(spark, df) == repair_by_hand(rows)


def test_one_conversation_with_most_rows_lies_in_many_tasks(spark):
    rng = random.Random(7)
    rows = [(1, k, ["user", "assistant"][k % 2], rng.choice(["ok.", "again", "", f"text {k}!"])) for k in range(20_000)]
    rows += [(2, k, "user", "same.") for k in range(50)]
    df = spark.createDataFrame(rows, CONVERSATION)
    with Scratch(spark) as scratch:
        placed = turn_repair.place_rows(df, scratch)
        held = placed.filter("conv_id = 1").groupBy(F.shiftright("row", turn_repair.PART_BITS)).count().collect()
        assert len(held) > 1
    assert repaired(spark, df) == repair_by_hand(rows)


def test_no_conversations(spark):
    assert repaired(spark, spark.createDataFrame([], CONVERSATION)) == {}


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, *range(30)) for r, x in [("assistant", "A. b! c?"), (None, None)]]
    wanted = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        wanted += [(conv, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    got = [tuple(r) for r in turn_repair.damage(with_clashes(spark.createDataFrame(rows, CONVERSATION))).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


# Lines ------------------------------------------------------------------------


def lines_by_hand(rows):
    owners = {}
    rank = lambda d: (d is None, d or 0)
    key = lambda line: line.strip(SPACES).translate(FOLD)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)] = min(owners.get(key(line), rank(doc_id)), rank(doc_id))
    made = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owners[key(x)] == rank(doc_id)]
        made.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(made, key=repr)


def odd_documents():
    rng = random.Random(8)
    pool = ["a common line here", "  A Common LINE here\t", "short", "", "İstanbul'da bir gün", "i̇stanbul'da bir gün", "ÉTÉ À PARIS 1", "été à paris 1", "exactly 10", "nine char", " padded line here ", "𝒳" * 9, "𝒳" * 10]
    texts = ["\n".join(rng.choice([*pool, f"line number {rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = list(enumerate(texts, -10)) + [(100, None), (101, ""), (102, "\n"), (103, "\n\n a \n")]
    rows += [(None, texts[3]), (None, "only without an id\na common line here"), (7, "another text of seven\n" + texts[3])]
    rows += [(8, texts[18]), (8, texts[18]), (104, "\n".join(f"row {k % 3000} of a long text" for k in range(6000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (7, 3), (40, 2)])
def test_deduplicated_lines(spark, batches, fan):
    rows = odd_documents()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    with Scratch(spark) as scratch:
        made = line_dedup.dedup_lines(df, scratch, batches, fan)
        got = sorted((tuple(r) for r in made.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == lines_by_hand(rows)


def test_no_documents_have_no_lines(spark):
    with Scratch(spark) as scratch:
        assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), scratch).collect() == []


def test_runs_are_compacted_and_hold_each_hash_once(spark):
    with Scratch(spark) as scratch:
        runs = line_dedup.LineRuns(scratch, fan=2)
        for batch in range(7):
            keys = [(h, -h, batch) for h in range(batch * 10, batch * 10 + 15)]
            runs.add(spark.createDataFrame([*keys, *keys], "h1 long, h2 long, doc_id long"))
        assert [len(level) for level in runs.levels] == [1, 1, 1]
        owners = sorted((r["h1"], r["doc_id"]) for r in runs.owners().collect())
        assert owners == [(h, min(max(0, (h - 5) // 10 if h % 10 < 5 else h // 10), 6)) for h in range(75)]
        plan = runs.fresh(spark.createDataFrame([(1, 1)], "h1 long, h2 long"))._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        # The batch alone is shuffled, the runs are merged as they lie.
        assert physical.count("Exchange hashpartitioning") == 1 and physical.count("SortMergeJoin") == 3
        tables = runs.runs()
        runs.close()
        assert not any(spark.catalog.tableExists(name) for name in tables)


def test_line_deduplication_has_no_python_worker(spark):
    df = spark.createDataFrame(odd_documents(), "doc_id long, text string")
    with Scratch(spark) as scratch:
        plan = line_dedup.dedup_lines(df, scratch)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


# Alignment --------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.tokenizers_of(tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


def whole_ids(text, tokenizers):
    """Ids of a whole text by the two libraries alone."""
    a, b = tokenizers
    return [a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)]


def test_parts_have_the_ids_of_the_whole_text(tokenizers):
    rng = random.Random(10)
    pieces = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u2028", "a", "the", "É", "1", "'s", "...", "\n ", " \n", "é́", "\u200b", "🙂", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        parts = alignment.parts_of(text)
        assert "".join(" " + p for p in parts) == " " + text
        assert [sum(t.ids(parts), []) for t in tokenizers] == whole_ids(text, tokenizers), repr(text)


def test_long_runs_without_a_cut(tokenizers):
    for text in (" " * 300_000, "\n" * 200_000, "!?" * 100_000, "q" * 300_000):
        assert [t.ids([text])[0] for t in tokenizers] == whole_ids(text, tokenizers)


def align_by_hand(texts, tokenizers):
    """Token counts, groups and links of texts, from offsets alone."""
    made = []
    for text in texts:
        if not text:
            made.append((0, 0, [], [], ""))
            continue
        ids = whole_ids(text, tokenizers)
        spelled = [[t.spelled[k] for k in x] for t, x in zip(tokenizers, ids)]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            made.append((0, 0, [], [], ""))
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
        groups, links, done = [], [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(cut) + 1 for e in ends]
            a, b = (x[i:j] for x, i, j in zip(ids, done, upto))
            groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            links.append((a[-1], b[-1]))
            done = upto
        made.append((len(ids[0]), len(ids[1]), groups, links, sha(";".join(groups))))
    counts = collections.Counter(x for m in made for x in m[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (a, b, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), digest)
        for a, b, g, x, digest in made
    ]


def odd_texts():
    rng = random.Random(9)
    words = ["the", "cat", "Straße", "naïve", "世界", "🙂", "İ", "<s>", "</s>", "<|endoftext|>", "<0x41>", "１２", "\n", "\t ", "  ", "tokenization", "ünïcödé"]
    texts = [None, "", " ", "x", "a▁b", "\x00", "é́ \x1c \x85 　 ½ ﬁ", "the cat", "the cat", "y" * 50_000, "the " * 20_000]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]


@pytest.mark.parametrize("sent", [0, 5, 1 << 16])
def test_aligned_documents(spark, tokenizers, sent):
    texts = odd_texts()
    df = with_clashes(spark.createDataFrame([(None if k == 20 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    paths = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
    with Scratch(spark) as scratch:
        got = [tuple(r) for r in alignment.align_documents(df, *paths, scratch, sent).collect()]
    wanted = [(None if k == 20 else k // 2, *told) for k, told in enumerate(align_by_hand(texts, tokenizers))]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_forgetting_parts_changes_nothing(tokenizers, monkeypatch):
    texts = [t for t in odd_texts() if t]
    wanted = {}
    for most in (300_000, 3):
        monkeypatch.setattr(alignment, "REMEMBERED", most)
        known = alignment.AlignedParts(*tokenizers)
        for text in texts * 2:
            numbers = known.numbers([known.parts(text)])[0]
            told = None if min(numbers) < 0 else (b";".join(known.groups[k] for k in numbers), known.counts[numbers].sum(axis=0).tolist())
            assert wanted.setdefault(text, told) == told


def test_no_documents_align(spark):
    paths = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
    with Scratch(spark) as scratch:
        assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), *paths, scratch).collect() == []


def test_pointers_jump_to_the_end_of_every_chain():
    rng = np.random.default_rng(1)
    pointer = np.minimum(np.arange(5000) + rng.integers(0, 2, 5000) * rng.integers(1, 40, 5000), 4999)
    wanted = []
    for k in range(5000):
        while pointer[k] != k:
            k = pointer[k]
        wanted.append(k)
    assert alignment.jump(pointer).tolist() == wanted


def test_a_whole_text_may_be_one_component():
    """Tokens of 2 bytes against tokens shifted by one byte: one chain through the whole text."""
    size_a, size_b = np.array([2]), np.array([2, 1])
    a, b = np.zeros(10_000, np.int64), np.zeros(10_001, np.int64)
    b[[0, -1]] = 1
    found = alignment.align([a, a[:1]], [b, b[:1].repeat(2)], size_a, size_b)
    assert found["n_groups"] == [1, 1]
    assert found["groups"][1] == b"0|1,1"


# All --------------------------------------------------------------------------


def test_nothing_but_results_stays_in_the_shared_folder(spark):
    import os

    from newsgraph.llm.catalog import QUERIES

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for name in ("op11_turn_repair", "op12_line_dedup", "op13_token_alignment"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("scratch")]
