"""Look-ups of many keys in one block of the capture index."""

import zlib

import pandas as pd

from tidemark.llm import warc


def test_block_is_decoded_once_for_all_keys(monkeypatch):
    lines = [(f"a,{i // 3:04}", f"w{i}", i, 2 * i) for i in range(999)]
    packed, calls, unpack = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode()), [], zlib.decompress
    monkeypatch.setattr(warc.zlib, "decompress", lambda *a, **k: calls.append(1) or unpack(*a, **k))
    wanted = [f"a,{i:04}" for i in range(0, 400, 2)]  # the last ones are not in the block
    got = warc.pick(pd.DataFrame({"key": wanted}), pd.DataFrame({"block": [packed]}))
    assert list(got.itertuples(index=False, name=None)) == [x for x in lines if x[0] in wanted]
    assert len(calls) == 1
    assert warc.pick(pd.DataFrame({"key": wanted}), pd.DataFrame({"block": []})).empty
