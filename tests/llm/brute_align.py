"""Brute-force alignment of two tokenizations, token by token."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tracewell.llm.bpe import byte_characters


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.back = {c: b for b, c in enumerate(byte_characters())}

    def tokens(self, text):
        """(A ids, A bytes, B ids, B bytes); nothing where the bytes do not agree."""
        if not text:
            return [], [], [], []
        code = self.a.encode(" " + text, add_special_tokens=False)
        raw_a = [bytes(self.back[c] for c in t) for t in code.tokens]
        ids_b = self.b.encode(text)
        raw_b = []
        for i in ids_b:
            name = self.b.id_to_piece(i)
            raw_b.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return [], [], [], []
        return code.ids, raw_a, ids_b, raw_b

    def groups(self, text):
        ids_a, raw_a, ids_b, raw_b = self.tokens(text)
        ends = [[], []]
        for side, raw in ((0, raw_a), (1, raw_b)):
            at = 0
            for r in raw:
                at += len(r)
                ends[side].append(at)
        cuts, out = sorted(set(ends[0]) & set(ends[1])), []
        i = j = 0
        for cut in cuts:
            a, b = [], []
            while i < len(ids_a) and ends[0][i] <= cut:
                a.append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends[1][j] <= cut:
                b.append(ids_b[j])
                j += 1
            out.append((a, b))
        return out

    def corpus(self, rows):
        """The result for (doc_id, text) rows."""
        parted = [(d, self.groups(t)) for d, t in rows]
        counts = Counter()
        for _, groups in parted:
            counts.update({(x, y) for a, b in groups for x in a for y in b})
        most = {}
        for (x, _), n in counts.items():
            most[x] = max(most.get(x, 0), n)
        out = []
        for d, groups in parted:
            links = [(x, y) for a, b in groups for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
            n_a, n_b = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups)
            n_best = sum(counts[p] == most[p[0]] for p in links)
            out.append((d, n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
        return out
