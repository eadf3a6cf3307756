from chronogrid.llm import bpe
from chronogrid.llm.token_files import Encoder


def test_chunks_that_end_in_signs_share_the_cache():
    with open(bpe.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = Encoder(f.read(), 0)
    alone = ["the&&& dog, here. THE!! end%%%", "a | b", "x***\ny$$$ z.", "(b) don't,*** 3.5 é&", "the&&&"]
    marked = ["the&&&, dog", "end%%%. So", "a |, b", ", a", ",, b", "x***\n, y"]
    for text in alone:
        assert e.encode(text) == e._all([text])[0] + e.end
    assert not e.whole.known and e.bare.ragged
    for text in marked:
        assert e.encode(text) == e._all([text])[0] + e.end
    assert e.whole.known
