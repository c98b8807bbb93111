"""The key of the token cache names the release of the library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from sensorlake.llm import token_counts


@pytest.mark.parametrize(("library", "name"), [(sentencepiece, "piece_bpe_32k.model"), (tokenizers, "word_bpe_49k.json")])
def test_another_release_is_another_key(monkeypatch, library, name):
    path = public_tokenizers.path(name)
    token_counts.version.cache_clear()
    before = token_counts.version(path)
    with open(path, "rb") as file:
        assert before == f"{library.__name__}:{library.__version__}:{hashlib.sha256(file.read()).hexdigest()}"
    monkeypatch.setattr(library, "__version__", "0.0.1")
    token_counts.version.cache_clear()
    assert token_counts.version(path) != before
    token_counts.version.cache_clear()
