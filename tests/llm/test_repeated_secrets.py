"""Equal encoded secrets at several places of one text."""

from __future__ import annotations

import gzip
from base64 import b64encode

from airspark.llm.secrets import find_secrets


def test_every_copy_of_a_blob_gives_its_spans():
    for data in (b"password=hunter22", gzip.compress(b"password=hunter22 " * 3, mtime=0), b64encode(b"password=hunter22")):
        blob = b64encode(data).decode()
        text = f"a {blob} b {blob}\n{blob}"
        _, spans, layers, refused = find_secrets(text)
        own = [p for p in range(len(text)) if text.startswith(blob, p)]
        assert len(own) == 3 and refused == 0 and layers >= 4
        for at in own:
            assert any(at <= a and b <= at + len(blob) for a, _, b in spans)
        # All copies give the same spans, moved.
        by = [sorted((a - at, k, b - at) for a, k, b in spans if at <= a < at + len(blob)) for at in own]
        assert by[0] == by[1] == by[2]


def test_an_equal_copy_next_to_other_encodings():
    blob = b64encode(b"password=hunter22").decode()
    _, spans, _, _ = find_secrets(f"%41 {blob} &#65; {blob}")
    assert len(spans) == 2
