"""The encoder of whole texts: ids are those of plain calls, however few pieces it remembers, and each piece is made once."""

import gc

import numpy as np
import pytest

from atlasrun.llm import tokens
from atlasrun.llm.queries import vocabulary

TEXTS = ["Straße über words, words. WORDS\nwords%% wörds,. a", "", " two  spaces\n\nand words. ", "words, words. new% new%", "x y words"]


@pytest.mark.parametrize("kept", [0, 3, 1000])
@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", tokens.SPACED_WORDS), ("word_bpe_49k.json", tokens.LOWER_WORDS)])
def test_pieces_are_made_once(monkeypatch, kept, name, kind):
    monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
    known, made = tokens.Encoder(vocabulary(name), kind), []
    make = known.known.make
    known.known.make = lambda piece: made.append((gc.isenabled(), piece)) or make(piece)
    for _ in range(2):
        got = known.encode([t.encode() for t in TEXTS])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
        assert len(made) == len(set(made)) and not any(on for on, _ in made) and gc.isenabled()
        if kept < 1000:
            made.clear()
    assert len(known.known) <= kept and not known.known.others


ENDS = ["", ".", ",", "&&&", ".***", "'", "'.", "!'", "\"", ")", "$$$", "<", "%%%,", "-", "_", "^", "`"]
BEGINS = ["word", "Word", "wörd", "été", "naïvé", "a×", "b÷", "1", "(9", "don't", "x.y", "“q”", "ªº", "é", "İ", "ΟΔΟΣ", "界", "�", "***", "'s", "we're", "ß"]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", tokens.SPACED_WORDS), ("word_bpe_49k.json", tokens.LOWER_WORDS)])
def test_symbols_at_the_end(name, kind):
    """A word is made once, whatever symbols follow it; the ids are those of plain calls."""
    known, made = tokens.Encoder(vocabulary(name), kind), []
    make = known.known.make
    known.known.make = lambda piece: made.append(piece) or make(piece)
    texts = [f"{before}{word}{end}" for before in ("", "a ", "a\n", "a\n\n", "a  ") for word in BEGINS for end in ENDS]
    texts += [" ".join(w + e for w in BEGINS for e in ENDS), "\n".join(w + e for w in BEGINS for e in ENDS)]
    got = known.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(p for p in made if p.lower().startswith(b"word")) == ([b"Word", b"word"] if kind.spaced else [b"word"])
