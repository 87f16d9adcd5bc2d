"""Token ids of whole texts as the library of a vocabulary file gives them: tokenizers for .json, sentencepiece for
.model, without begin, end or added special tokens, truncation or padding.

For byte-level vocabularies whose ids follow the order of their merges, tiktoken runs the same merges from the same
file about four times as fast. Texts of ordinary characters without special strings take that way, all others the
library itself; the tests hold the two equal.
"""

import hashlib
import json
import re
from array import array

#: The word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that every version of Unicode puts into the same class: to the end of Latin Extended-B, but for
#: control characters and the no-break space, and some general punctuation.
_ORDINARY = re.compile("[\t\n\r -~¡-ɏ–—‘’“”…€]*")


def version_digest(path):
    """Digest of a tokenizer's file, so that stored counts are tied to its exact version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Encoder:
    """Encodes texts with the vocabulary in ``path``."""

    def __init__(self, path):
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.special = [t["content"] for t in settings.get("added_tokens") or []]
        ranks = _ranks(settings)
        if ranks:
            import tiktoken

            name = "ranks of " + path
            self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text):
        """The text's ids as bytes of little-endian unsigned 32-bit integers."""
        if self.fast and _ORDINARY.fullmatch(text) and not any(map(text.__contains__, self.special)):
            found = self.fast(text)
        else:
            found = self.whole(text) if text else ()
        return array("I", found).tobytes()

    def count(self, text):
        return len(self.ids(text)) // 4


def _ranks(settings):
    """Byte strings with their ids, if the file's steps are plain byte-level ones and ids follow the merges' order."""
    steps, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = (
        steps.get("type") == "ByteLevel"
        and steps.get("use_regex", True)
        and not steps.get("add_prefix_space", True)
        and not settings.get("normalizer")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    if not plain:
        return None
    # byte-level files write printable bytes as themselves and the others as the next signs from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in settings.get("added_tokens") or []}
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if merged != sorted(merged, key=lambda i: -1 if i is None else i) or None in merged:
        return None
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token not in special}
