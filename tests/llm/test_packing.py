import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from gradecube.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_plan(counts, capacity, ranges, sequences):
    """Every document once, no sequence over its capacity, places without gaps."""
    of = defaultdict(list)
    numbers = defaultdict(list)
    for length, first, end, begin, each, place in ranges:
        for r in range(first, end):
            further, which = divmod(r - first, each)
            of[begin + further].append((place + which * length, length))
            numbers[length].append(r)
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for parts in of.values():
        at = 0
        for place, length in sorted(parts):
            assert place == at
            at += length
        assert at <= capacity
    assert sorted(of) == list(range(sequences))


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rnd = random.Random(seed)
    capacity = 200
    draw = [lambda: rnd.randint(1, 200), lambda: rnd.randint(60, 110), lambda: min(200, int(rnd.expovariate(1 / 60)) + 1), lambda: rnd.choice([67, 66, 101, 34]), lambda: rnd.randint(90, 130), lambda: rnd.randint(1, 9)][seed]
    counts = Counter(draw() for _ in range(3000))
    found = []
    for part in P.LARGE_PARTS:
        sequences, ranges = P.planned(counts, capacity, 32, part)
        check_plan(counts, capacity, ranges, sequences)
        found.append(sequences)
    bound = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
    plain = best_fit(counts, capacity)
    assert min(found) <= max(plain, bound * 1.02 + 1)


def best_fit(counts, capacity):
    rooms = []
    for n in sorted(counts.elements(), reverse=True):
        fit = [k for k, left in enumerate(rooms) if left >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_configurations_beat_best_fit():
    # Two fifths and three tenths fill a sequence as 40 + 30 + 30; best fit pairs the long ones and leaves gaps.
    counts = Counter({40: 300, 30: 600})
    assert best_fit(counts, 100) > 300
    assert min(P.planned(counts, 100, 8, part)[0] for part in P.LARGE_PARTS) == 300


def test_plan_does_not_grow_with_documents():
    rnd = random.Random(3)
    counts = Counter(rnd.randint(1, 200) for _ in range(5000))
    few, many = (len(P.planned({n: c * times for n, c in counts.items()}, 200)[1]) for times in (1, 1_000_000))
    assert many < 3 * few
    assert P.planned({}, 200) == (0, [])


def test_ids_are_those_of_the_tokenizer():
    texts = ["It's  a test\n\n of 12 things,\tisn't it?  ", " lead", "a  b \n c\x0bd", "été Łódź ×÷", "中文 русский \U0001f600", "x y \x1cz \x85", "<|endoftext|> don't 'll 've'", "", "a" * 3000, "café ²½", " ".join(["word"] * 50)]
    want = [struct.pack(f"<{len(w) - 1}I", *w[:-1]) for w in map(whole, texts)]
    assert P.Ids(FILE).of(texts) == want


def test_words_forgotten_and_stretches(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    monkeypatch.setattr(P, "STRETCH", 7)
    texts = ["several words, and\n more  of them here", "others again  \n", "words"]
    ids = P.Ids(FILE)
    for _ in range(2):
        assert ids.of(texts) == [struct.pack(f"<{len(w) - 1}I", *w[:-1]) for w in map(whole, texts)]


def rows_of(seed):
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefgé", k=rnd.randint(1, 8))) for _ in range(n))
    return [(k, prose(rnd.choice([0, 1, 5, 30, 90, 400])), k) for k in range(150)] + [(900, None, 0), (901, "", 0), (None, "no id", 0), (950, "same", 0), (950, "same", 0), (902, prose(3000), 0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, parts):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long").repartition(parts)
    placed = P.packed(df, FILE, capacity=256, groups=16, with_ids=True)
    out = placed.collect()
    want = Counter((d, tuple(whole(t))) for d, t, _ in rows)
    seen = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 256 and (r.length == 256 or r.piece == 0)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        seen[r.sequence_id].append(r)
    for parts_of in seen.values():
        at = 0
        for r in sorted(parts_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    found = Counter()
    for d, own in by.items():
        own.sort(key=lambda r: (r.start, r.piece))
        if d == 950:
            found.update((d, tuple(r.ids)) for r in own)
        else:
            assert [r.piece for r in own] == list(range(len(own)))
            found[d, tuple(x for r in own for x in r.ids)] += 1
    assert found == want
    total = sum(r.length for r in out)
    assert len(seen) <= -(-total // 256) + 2
    joined = {r.sequence_id: r for r in P.sequences(placed).collect()}
    for k, parts_of in seen.items():
        assert joined[k].ids == [x for r in sorted(parts_of, key=lambda r: r.offset) for x in r.ids]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.packed(df, FILE).count() == 0
