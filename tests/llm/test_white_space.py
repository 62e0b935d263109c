"""Ids of texts whose single spaces touch other white space, against the library."""

import random


def test_spaces_beside_other_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    from voxframe.llm.bpe_codec import ByteBPE

    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, library = ByteBPE(path), Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["a \xa0 \xa0 b", "a\xa0 \xa0 \xa0", " \n \n x", "\xa0 " * 9 + "end"]
    texts += ["".join(r.choice([" ", "\xa0", "\n", "\t", "\u3000", " ", "a", "b1", ",", "'s"]) for _ in range(r.randrange(30))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)
