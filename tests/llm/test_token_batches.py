"""Token ids by batch: one piece per core, texts of many scripts."""

import pyarrow as pa

from carrierlake.llm import tokens

ODD = ["", None, "Straße ÀÉ÷× ab_c d2e x\x1cy", "ΟΔΟΣ ΣΑΣ. İI ǅ", "a² ⅷ º1 x٣y", "日本 語, 日本", "\n\tab  Ab AB.\n", "é é  ab"]


def test_encoder_asks_for_each_piece_once(monkeypatch):
    """One core in both cases, with and without final marks, is one piece for the tokenizer, and none in a later batch."""
    asked = []
    encode = tokens.Encoder.encode_pieces
    monkeypatch.setattr(tokens.Encoder, "encode_pieces", lambda self, pieces: asked.append(sorted(pieces.to_pylist())) or encode(self, pieces))
    encoder = tokens.Encoder(tokens.default_vocabulary())
    first = encoder.encode(pa.array(["Word word, WORD! x.y", "word."]), 2)
    again = encoder.encode(pa.array(["Word word, WORD! x.y", "word."]), 2)
    assert asked == [["!", ",", ".", "word", "x.y"]]
    assert [x.tolist() for x in first] == [x.tolist() for x in again]


def test_encoder_on_texts_of_many_scripts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    texts = [*ODD, "क्. क, ก็. ǅ, ª. º! ⅷ, 語. a&&&, b$$. é.,!"]
    ends, ids = tokens.Encoder(tokens.default_vocabulary(), cache=4).encode(pa.array(texts), 2)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
