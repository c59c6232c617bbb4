"""Repeated passages against a scan of all runs of 20 words."""

import random

import brute
import pytest
from test_edges import prose

from atlasrun.llm import chunk_dedup

N = chunk_dedup.PASSAGE_WORDS


def removed_words(rows):
    """For each row the places of words in a run that a lesser id has, or that stands before in the row without a common word."""
    least, out = {}, []
    for doc, text in rows:
        w = brute.words(text)
        for k in range(len(w) - N + 1):
            run = tuple(w[k:k + N])
            least[run] = min(doc, least.get(run, doc))
    for doc, text in rows:
        w, seen, gone = brute.words(text), {}, set()
        for k in range(len(w) - N + 1):
            run = tuple(w[k:k + N])
            if least[run] < doc or k - seen.setdefault(run, k) >= N:
                gone.update(range(k, k + N))
        out.append(gone)
    return out


def check(docs_of, rows):
    left = {}
    for r in chunk_dedup.remove_repeats(docs_of(rows)).collect():
        left[r.doc_id] = brute.words(r.text)
    want = {doc: [x for k, x in enumerate(brute.words(text)) if k not in gone] for (doc, text), gone in zip(rows, removed_words(rows))}
    assert left == want
    return want


def test_common_phrases_are_no_passage(docs_of):
    """Texts of phrases that other documents have one by one keep every word, and a first holder its passage."""
    phrases = [prose(8, 1000 + k) for k in range(40)]
    r, rows = random.Random(1), [(k, f"{prose(30, 2000 + k)} {p} {prose(30, 3000 + k)}") for k, p in enumerate(phrases)]
    rows += [(100 + k, " ".join(r.sample(phrases, 25))) for k in range(30)]
    passage = " ".join(phrases[5:12])
    rows += [(200, f"{prose(20, 1)} {passage} {prose(20, 2)}"), (201, f"{prose(9, 3)} {passage} {prose(7, 4)}")]
    want = check(docs_of, rows)
    assert want[200] == rows[-2][1].split() and len(want[201]) == 16


def test_white_space_between_words_does_not_count(docs_of):
    def in_lines(words, by, blank):
        return "".join(w + (blank if k % by == by - 1 else " ") for k, w in enumerate(words))

    rows, own = [], []
    for k, blank in enumerate(["\r\n", "\n\n", "\n    ", "  ", " \t\r\n\r\n ", "\x0b\x0c"] * 4):
        words = prose(51 if k % 2 else 60, 4000 + k).split()
        rows += [(2 * k, f"{prose(25, 5000 + k)} {' '.join(words)} {prose(25, 6000 + k)}"),
                 (2 * k + 1, f"{prose(11, 7000 + k)}{blank}{in_lines(words, 10 if k < 12 else 6, blank)} {prose(9, 8000 + k)}")]
        own.append(20)
        cuts = [{b" ".join(t.encode()[a:b].split()) for a, b, _ in zip(*chunk_dedup.chunk_bounds(t.encode()))} for t in (" ".join(words), in_lines(words, 6, blank))]
        assert cuts[0] == cuts[1]
    want = check(docs_of, rows)
    assert [len(want[2 * k + 1]) for k in range(len(own))] == own


def test_passages_are_cut_to_the_word(docs_of):
    """Passages from 20 words on, at the begin, in the middle and at the end of texts, and twice in one."""
    r, rows = random.Random(7), []
    for k in range(150):
        words = prose(r.choice([20, 21, 25, 33, 51, 60]), 9000 + k)
        rows += [(3 * k, f"{prose(r.randrange(40), 10_000 + k)} {words} {prose(r.randrange(40), 11_000 + k)}"),
                 (3 * k + 1, f"{prose(r.randrange(1, 40), 12_000 + k)} {words} {prose(r.randrange(40), 13_000 + k)}"),
                 (3 * k + 2, f"{prose(19, 14_000 + k)} {' '.join(words.split()[:19])} {prose(5, 15_000 + k)} {prose(30, 14_000 + k)} {prose(2, k)} {prose(30, 14_000 + k)}")]
    want = check(docs_of, rows)
    assert sum(map(len, want.values())) < sum(len(t.split()) for _, t in rows)


def test_overlapping_copies(docs_of):
    """Stretches of few texts over a small vocabulary, lines that go on repeating, and runs with several sources."""
    r = random.Random(3)
    base = [prose(150, 20_000 + k).split() for k in range(4)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(r.randint(1, 6)):
            b = r.choice(base)
            a = r.randrange(len(b))
            text += b[a:a + r.randint(5, 60)]
        rows.append((k * 7 % 121, " ".join(text)))
    rows += [(500, "x " * 90), (501, "a b c d e f g " * 20), (502, "y " * 25), (503, " ".join(["y"] * 39))]
    check(docs_of, rows)
    texts = dict(rows)
    for p in chunk_dedup.repeated_passages(docs_of(rows)).collect():
        piece = texts[p.doc_id].encode()[p.start:p.start + p.length].decode()
        assert len(brute.words(piece)) == p.n_words > 0 and p.first_doc_id <= p.doc_id
        assert p.removed or p.first_doc_id == p.doc_id
        assert " ".join(brute.words(piece)[:3]) in " ".join(brute.words(texts[p.first_doc_id]))


def test_equal_runs_have_equal_seeds():
    """Wherever a run stands and whatever is around it, also over few words and for other lengths of runs."""
    r = random.Random(11)
    for width in (2, 3, 5, 8, 13, N, 40):
        known = {}
        for k in range(120):
            letters = "ab" if k % 3 else "abcdefgh"
            base = random.Random(k // 4).choices(letters, k=60)
            text = r.choices(letters, k=r.randrange(30)) + base[r.randrange(20):] + r.choices(letters, k=r.randrange(30))
            found = chunk_dedup.Texts([" ".join(text).encode()], width).seeds()
            assert len(found) == max(0, len(text) - width + 1)
            for at, seed in enumerate(found.tolist()):
                assert known.setdefault(tuple(text[at:at + width]), seed) == seed
        assert len(set(known.values())) > 1


def test_words_of_long_texts_have_the_same_hashes(monkeypatch):
    """Words are hashed alike wherever they stand and however the text is taken in stretches."""
    data = f"{prose(300, 1)} {'long' * 400} \u00e9t\u00e9 {prose(50, 2)}\r\n end".encode()
    bounds = chunk_dedup.word_bounds(data)
    assert [data[a:b] for a, b in zip(*bounds)] == data.split()
    whole, of = chunk_dedup.word_hashes(data, *bounds).tolist(), {}
    assert all(of.setdefault(w, h) == h for w, h in zip(data.split(), whole)) and len(set(of.values())) == len(of)
    monkeypatch.setattr(chunk_dedup, "TOGETHER", 100)
    assert chunk_dedup.word_hashes(data, *bounds).tolist() == whole


def test_blocks_hold_all_runs_of_their_seed():
    """Texts whose block of a seed is equal have the same runs with that seed; texts hashed together are kept apart."""
    r, held, rows = random.Random(5), {}, [b"", b" \n ", b"few words"]
    for k in range(60):
        rows.append(" ".join(r.choices("abcd", k=r.randrange(10)) + prose(90, 30_000 + k // 3).split()[r.randrange(9):] + r.choices("abcd", k=r.randrange(10))).encode())
    r.shuffle(rows)
    together = list(zip(*(x.tolist() for x in chunk_dedup.Texts(rows, N).blocks())))
    alone = [(k, *x) for k, row in enumerate(rows) for _, *x in zip(*(x.tolist() for x in chunk_dedup.Texts([row], N).blocks()))]
    assert together == alone and len({k for k, _, _ in together}) == 60
    for k, row in enumerate(rows):
        words, runs = row.split(), {}
        for at, seed in enumerate(chunk_dedup.Texts([row], N).seeds().tolist()):
            runs.setdefault(seed, set()).add(tuple(words[at:at + N]))
        mine = [(seed, block) for text, seed, block in together if text == k]
        assert {seed for seed, _ in mine} == set(runs)
        for seed, block in mine:
            assert held.setdefault((seed, block), runs[seed]) == runs[seed]
    assert all(len(x) == 0 for x in chunk_dedup.Texts([], N).blocks())


def test_other_lengths(docs_of):
    """Runs of two words are the shortest that can be asked for."""
    rows = [(1, "a b c"), (2, "x a b y"), (3, "b"), (4, "")]
    left = {r.doc_id: r.text.split() for r in chunk_dedup.remove_repeats(docs_of(rows), passage_words=2).collect()}
    assert left == {1: ["a", "b", "c"], 2: ["x", "y"], 3: ["b"], 4: []}
    with pytest.raises(ValueError):
        chunk_dedup.repeated_passages(docs_of(rows), passage_words=1)
