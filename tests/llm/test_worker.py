"""Operators drop what others have left in a worker, and keep their own."""

from veilmark.llm import worker


def test_claims():
    dropped = []
    worker.claim("a", lambda: dropped.append("a"))
    worker.claim("a", lambda: dropped.append("a"))
    assert dropped == []
    worker.claim("b")
    worker.claim("c", lambda: dropped.append("c"))
    assert dropped == ["a"]
    worker.claim("b")
    assert dropped == ["a", "c"]
