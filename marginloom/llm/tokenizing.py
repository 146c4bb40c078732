"""Public tokenizers inside tasks: loaded once per Python worker, by the name or path of their file."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np


def vocabulary(name: str) -> str:
    """The path of a vocabulary file; absolute paths stay."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary(name))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@cache
def fast_encoder(name: str):
    """The byte-level vocabulary ``name``.json as ranks, if it is there: the same ids four times as fast."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {t.content: i for i, t in tokenizer(name).get_added_tokens_decoder().items()}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def byte_ids(text: str, name: str) -> np.ndarray:
    """The ids of ``text`` as the tokenizers library gives them."""
    try:
        return fast_encoder(name).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except BaseException as error:  # the regex engine gives up on some very long runs
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.array(tokenizer(name).encode(text, add_special_tokens=False).ids, "<u4")
