"""Words kept from one slice for the next change no ids, and no more than a slice's words are kept."""

from quillmeter.llm.pieces import Model
from quillmeter.llm.queries import TOKENIZERS


def test_slices_give_the_ids_of_one_slice():
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        data = f.read()
    texts = ["a first text", "another text, a first", "", None, "something else", "a first text again", "été 中 a"]
    whole, slices = Model(data), Model(data)
    expected = whole.encode(texts)
    assert [slices.encode([t])[0] for t in texts] == expected
    assert slices.words.keys() == {"▁été", "▁中", "▁a"}
    assert [slices.decode(i) for i in expected] == [t or "" for t in texts]
