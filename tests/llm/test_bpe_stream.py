"""The BPE transducer beyond short pieces: any feed gives the library's tokens, with bounded state."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import bpe

CODEC = bpe.Codec.of(bpe.default_path())
MACHINE = CODEC._memo.t


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_pairs_fit_by_definition():
    m, rng = CODEC.merges, random.Random(3)
    tokens = list(m.ids)
    assert m.proper
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert m.fits(a, b) == (m.merged(a + b) == [a, b])
    for i in range(1, 9):
        for j in range(1, 9):
            a, b = b"a" * i, b"a" * j
            if a in m.ids and b in m.ids:
                assert m.fits(a, b) == (m.merged(a + b) == [a, b])


def test_long_pieces_in_any_feed():
    rng = random.Random(4)
    for alphabet in (b"a", b"ab", b"theing", b"=-", b"\xc3\xa9\xe4\xb8\xad"):
        data = bytes(rng.choice(alphabet) for _ in range(3000))
        want = [CODEC.merges.ids[t] for t in CODEC.merges.merged(data)]
        for step in (1, 7, 1000):
            assert list(MACHINE.run(data[i : i + step] for i in range(0, len(data), step))) == want


def test_state_is_bounded():
    """Tokens come out while the piece goes on, at most the lookahead and two token lengths behind."""
    bound = MACHINE.lookahead + 3 * CODEC.merges.longest + 64
    for unit in (b"the", b"-", b"ab", b"\xe4\xb8\xad"):
        fed = 0

        def feed(unit=unit):
            nonlocal fed
            for i in range(6000):
                fed += 1
                yield unit[i % len(unit) : i % len(unit) + 1]

        out = 0
        for t in MACHINE.run(feed()):
            assert fed - out <= bound
            out += len(CODEC.merges.bytes_of[t])
        assert out == 6000


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text) == library_ids(text)
    assert CODEC.decode(CODEC.encode(text)) == text


_LIBRARY = library()


def library_ids(text):
    return _LIBRARY.encode(text, add_special_tokens=False).ids


def test_any_ids():
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(30)]
        want = _LIBRARY.decode(ids, skip_special_tokens=False)
        assert CODEC.decode(ids) == want
        assert "".join(CODEC.decode_stream(np.array([i], "<u4").tobytes() for i in ids)) == want


def test_every_piece_goes_through_the_transducer(monkeypatch):
    """A fresh codec feeds each distinct piece of a text to the machine once, and nothing else gives ids."""
    import regex

    codec, fed = bpe.Codec(bpe.default_path()), []
    run = codec._memo.t.run
    monkeypatch.setattr(codec._memo.t, "run", lambda chunks: fed.append(b"".join(chunks)) or run([fed[-1]]))
    text = "The cat, the hat and the unquestionablyverylongpiecewithoutanyspace" + "s" * 90 + " end. The cat"
    assert codec.encode(text) == library_ids(text)
    assert sorted(fed) == sorted({p.encode() for p in regex.findall(bpe.PATTERN, text)})


def test_windows_change_no_piece(monkeypatch):
    import regex

    rng = random.Random(8)
    for alphabet in ("ab  \n'1.", "é中 s'\t", "a ", "1a"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        for window in (1, 7, 50, 1 << 14):
            monkeypatch.setattr(bpe, "WINDOW", window)
            assert [p for some in CODEC._found(text) for p in some] == regex.findall(bpe.PATTERN, text)


def test_memory_is_flat_over_a_long_text():
    """Beside the text itself, a long text, one piece or many, takes no memory in proportion to its length."""
    import tracemalloc

    codec = bpe.Codec.of(bpe.default_path())
    for unit in ("the cat sat on the mat ", "ab"):
        peaks = []
        for n in (20_000, 200_000):
            text = (unit * n)[:n]
            list(map(len, codec.encode_stream(text[:9000])))
            tracemalloc.start()
            for _ in codec.decode_stream(codec.encode_stream(text)):
                pass
            peaks.append(tracemalloc.get_traced_memory()[1] - len(text))
            tracemalloc.stop()
        assert peaks[1] < peaks[0] + 150_000, (unit, peaks)
