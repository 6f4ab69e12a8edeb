import random
import zlib

from gradecube.llm import toxicity as T


def edits(a, b, swaps=False):
    """Edit distance; with swaps, two letters side by side may change places as one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_matches_edit_distance():
    rnd = random.Random(2)
    terms = {"".join(rnd.choices("abcd", k=rnd.choice([3, 5, 6, 7, 8, 10, 11, 12]))): float(k + 1) for k in range(40)}
    lexicon = T.Lexicon(terms, {})
    kinds = set()
    for k in range(4000):
        w = list(rnd.choice(list(terms))) if k % 2 else rnd.choices("abcd", k=rnd.randint(3, 13))
        for _ in range(rnd.randint(0, 3) if k % 2 else 0):
            j = rnd.randrange(max(1, len(w) - 1))
            if len(w) < 2:
                break
            w[j : j + 2] = rnd.choice([[w[j + 1], w[j]], [w[j]], [w[j], "a", w[j + 1]], ["d", w[j + 1]]])
        w = "".join(w)
        if T.RUNS.search(w) or len(w) < 3:
            continue
        one = max((g for t, g in terms.items() if min(len(t), len(w)) >= T.FUZZY_LENGTH and edits(w, t, True) <= 1), default=0.0)
        two = max((g for t, g in terms.items() if len(t) >= T.LONG_LENGTH and edits(w, t) <= 2), default=0.0)
        want = (3, terms[w]) if w in terms else (1, one or two) if one or two else (0, 0.0)
        assert lexicon.find(w) == want, w
        kinds.add((want[0], bool(one)))
    assert kinds >= {(3, True), (1, True), (1, False), (0, False)}


def test_words_looked_up_together_walk_little_of_a_lexicon_of_families(monkeypatch):
    rnd = random.Random(5)
    draw = lambda: rnd.choice(["loweis", "vequar", "achlich", "lostra"]) + "".join(rnd.choices("aeinrstu", k=rnd.randint(2, 7)))
    terms = {draw(): float(k + 1) for k in range(300)}
    lexicon, steps, walk = T.Lexicon(terms, {}), [0], T.Lexicon._fuzzy

    def counted(*args):
        steps[0] += 1
        return walk(*args)

    monkeypatch.setattr(T.Lexicon, "_fuzzy", counted)
    words = sorted({draw() for _ in range(1500)} | {"".join(rnd.choices("aeinrstu", k=rnd.randint(3, 14))) for _ in range(500)})
    words = [w for w in words if not T.RUNS.search(w)]
    T.features_of([" ".join(words[k::7]) for k in range(7)], lexicon)
    far = 0
    for w in words:
        one = max((g for t, g in terms.items() if min(len(t), len(w)) >= T.FUZZY_LENGTH and abs(len(t) - len(w)) < 2 and edits(w, t, True) <= 1), default=0.0)
        two = max((g for t, g in terms.items() if len(t) >= T.LONG_LENGTH and abs(len(t) - len(w)) < 3 and edits(w, t) <= 2), default=0.0)
        assert lexicon.find(w) == ((3, terms[w]) if w in terms else (1, one or two) if one or two else (0, 0.0)), w
        far += not (one or two)
    assert far > 500 and steps[0] < 200 * (len(words) - far)  # 930 with the whole trie walked


def test_spelling_and_context():
    lexicon = T.Lexicon({"idiot": 5.0}, {"lowei": 4.0})
    assert lexicon.find("1d10t") == (1, 5.0) and lexicon.find("idiooot") == (1, 5.0) and lexicon.find("idoit") == (1, 5.0)
    assert lexicon.find("loweigen") == (2, 4.0) and lexicon.find("lowei") == (2, 4.0)
    plain, quoted, said, you = (T.features(x, lexicon)[0] for x in ("an idiot here", 'an "idiot" here', "he said idiot here", "you idiot here"))
    assert you > plain > said > quoted > 0
    assert T.features(None, lexicon) == T.features("", lexicon) == [0, 0, 0, 0]


def rows(n, rnd):
    docs, labels = [], []
    for k in range(n):
        ws = rnd.choices(["alpha", "beta", "gamma", "delta"], k=40)
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                ws[rnd.randrange(40)] = rnd.choice(["vilezor", "grumpfen"])
        docs.append((k, " ".join(ws), "x"))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    return docs, labels


def test_learns_only_from_training_rows(spark):
    docs, labels = rows(600, random.Random(3))
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "you vilezor grumpfen vilezor", "x"), (9002, "word " * 50000, "x")]
    labels += [(9000, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    noisy = [(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t if t is not None else None) for i, q, t in labels]
    out = T.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    again = T.toxicity(d, spark.createDataFrame(noisy, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)  # held-out labels change nothing
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert all(by[k].predicted == (k % 5 == 0) and by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(600))
    assert by[9000].predicted == by[9001].predicted == by[9002].predicted == 0 and by[None].predicted == 1


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in T.toxicity(d, none).collect()] == [0, 0]
    assert T.toxicity(d.limit(0), none).count() == 0
