"""Public tokenizer vocabularies, loaded once per Python worker."""

from __future__ import annotations

import ast
import base64
import functools
import os

#: Folder of the vocabulary files; a parameter of every operator that encodes.
DEFAULT_DIR = os.environ.get("PALIMPSEST_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k"
#: Fixed value: the published pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pattern(folder: str = DEFAULT_DIR) -> str:
    """The pattern that the folder's `__init__.py` assigns to PATTERN, read as text and never run; else the published one."""
    try:
        with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
            tree = ast.parse(f.read())
    except (OSError, SyntaxError):
        return PATTERN
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(getattr(t, "id", None) == "PATTERN" for t in node.targets):
            try:
                found = ast.literal_eval(node.value)
            except ValueError:
                continue
            if isinstance(found, str):
                return found
    return PATTERN


@functools.lru_cache(maxsize=4)
def encoder(name: str = BYTE_BPE, folder: str = DEFAULT_DIR):
    """A tiktoken encoding without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern(folder), mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def splitter(name: str = BYTE_BPE, folder: str = DEFAULT_DIR):
    """The compiled pre-token pattern of the same encoding."""
    import regex

    return regex.compile(pattern(folder))
