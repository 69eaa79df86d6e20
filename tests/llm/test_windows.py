"""Word hashes against plain cutting."""

from hypothesis import given, settings
from hypothesis import strategies as st

from joinlab.llm.windows import word_hashes

SPACES = b" \t\n\x0b\x0c\r"
BYTES = st.lists(st.sampled_from([*SPACES, 0, 8, 14, 31, 33, 65, 97, 133, 160, 255]), max_size=150).map(bytes)


@settings(max_examples=300, deadline=None)
@given(BYTES)
def test_words_are_those_of_split(raw):
    words, hashes = raw.split(), word_hashes(raw).tolist()
    assert len(words) == len(hashes)
    assert hashes == [word_hashes(w).tolist()[0] for w in words]  # wherever a word stands
    assert len(set(words)) == len(set(hashes))


def test_words_of_all_lengths_differ():
    words = [fill * n for n in range(1, 80) for fill in (b"a", b"b", b"\x00", b"\xff")]
    words += [b"a" * k + b"b" + b"a" * (n - k - 1) for n in range(1, 80) for k in range(1, n)]
    words = sorted({w for w in words})
    assert len(set(word_hashes(b" ".join(words)).tolist())) == len(words)
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0
