"""Ids of a public byte-level BPE vocabulary, by installed libraries; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Texts of these letters only mean the same to both libraries, whatever Unicode version each has.
_COMMON = re.compile("[^\\x00-\\u024f\\u0370-\\u0373\\u0388-\\u0481\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings from a file of base64 strings and ranks; read once a process."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids as ``tokenizers`` gives them for ``vocabulary``, with ``add_special_tokens=False``.

    ``ranks`` is the same vocabulary for ``tiktoken``, which is four times as fast; texts with letters
    on which the libraries' Unicode tables could differ, and texts that hold an added token of the
    vocabulary, go to ``tokenizers`` itself, in its default setting. Built once a process: workers are reused.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={})
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    at = re.search(r'"added_tokens"\s*:\s*', text)  # that list only, not the whole vocabulary
    added = [t["content"] for t in json.JSONDecoder().raw_decode(text, at.end())[0]] if at else []
    del text
    slow = re.compile("|".join([_COMMON.pattern, *map(re.escape, added)]))
    exact: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not slow.search(text):
            return np.asarray(quick.encode_ordinary(text), np.uint32)
        if not exact:
            exact.append(Tokenizer.from_file(vocabulary))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode
