"""incremental_keys goes through the streaming dedup."""

from scanframe.plans import queries, views
from scanframe.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_keys_come_from_the_stream(spark, monkeypatch):
    streams = []
    plain = incremental.first_of_each
    monkeypatch.setattr(incremental, "first_of_each", lambda found: streams.append(found.isStreaming) or plain(found))
    got = sorted(map(tuple, queries.QUERIES["incremental_keys"](spark, SF).collect()))
    assert streams == [True]
    assert got == sorted({(r.file, r.line, r.type) for r in views.found(spark, SF).collect()})
