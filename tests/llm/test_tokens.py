"""The encoder's store of pre-tokens."""

import random

import numpy as np
from tokenizers import Tokenizer

from stridelake.llm.queries import tokenizer_path
from stridelake.llm.tokens import Encoder


def test_encoder_finds_pre_tokens_by_sorted_hashes():
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    for most in (5, 400_000):
        enc = Encoder(tokenizer_path(), most)
        for text in ("one two, three", "two 'll three four\n\n five", "", "ééé one one", "one two, three"):
            data = np.frombuffer(text.encode(), np.uint8)
            ids, per = enc.ids(data, np.array([0, len(data)]))
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and per.tolist() == [len(ids)]
            assert len(enc.hashes) == len(enc.row) and (enc.hashes[1:] > enc.hashes[:-1]).all()


def test_common_pre_tokens_go_to_the_model_and_rare_ones_to_the_whole_tokenizer():
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    enc, asked, rnd = Encoder(tokenizer_path()), [], random.Random(1)
    whole = enc._whole
    enc._whole = lambda data, start, end: asked.extend(data[a:b].tobytes() for a, b in zip(start, end)) or whole(data, start, end)
    common = ["".join(map(chr, range(0x240))), "<|endoftext|> it's 'll don't\n\n  x", *("".join(rnd.choices([*map(chr, range(0x240)), *" \n'" * 40], k=60)) for _ in range(200))]
    for texts, rare in ((common, False), (["naïve ’quoted’ 東京 и 😀ok　x"], True)):
        texts = [t.encode() for t in texts]
        ids, per = enc.ids(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
        want = [plain.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        assert np.split(ids, np.cumsum(per)[:-1])[0].tolist() == want[0] and ids.tolist() == sum(want, []) and per.tolist() == [len(w) for w in want]
        assert bool(asked) == rare
    assert " 東京".encode() in asked and b"na\xc3\xafve" not in asked
