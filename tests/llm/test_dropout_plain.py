"""Merge-dropout against a plain segmenter that shares no code with the operator."""

from __future__ import annotations

import pytest

from lumensift.llm import piece_dropout

MASK = 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def skipped(seed, doc_id, place, step, dropout):
    """A draw below the limit: 32 of the 64 bits of a hash, the low ones for even steps."""
    key = mixed((mixed((doc_id & MASK) ^ mixed(seed & MASK)) + place * 0x9E3779B97F4A7C15) & MASK)
    x = (key + step // 2 * 0xD1B54A32D192ED03) & MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    x ^= x >> 29
    half = x >> 32 if step % 2 else x & 0xFFFFFFFF
    return half < round(dropout * 2**32)


def is_letter(c):
    return not (ord(c) <= 0x40 or 0x5B <= ord(c) <= 0x60 or 0x7B <= ord(c) <= 0xBF or 0x2000 <= ord(c) <= 0x206F)


def units(text):
    """Spaces, and the run of letters or of other characters behind them."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] == " ":
            end += 1
        if end < len(text):
            kind = is_letter(text[end])
            while end < len(text) and text[end] != " " and is_letter(text[end]) == kind:
                end += 1
        out.append(text[at:end])
        at = end
    return out


class Plain:
    def __init__(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.default_model())
        self.ids, self.byte = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.ids[piece] = (i, model.get_score(i))

    def unit(self, unit, doc_id, place, seed, dropout):
        """The best pair that was not skipped is merged until there is none: by score, then from the left. A skipped pair of symbols at its places is not proposed again."""
        symbols = [(n, n + 1, "▁" if c == " " else None if c == "▁" else c) for n, c in enumerate(unit)]
        dead, step = set(), 0
        while True:
            pairs = []
            for (a, m, x), (_, b, y) in zip(symbols, symbols[1:], strict=False):
                if x is not None and y is not None and x + y in self.ids and (a, m, b) not in dead:
                    pairs.append((-self.ids[x + y][1], a, m, b))
            if not pairs:
                break
            _, a, m, b = min(pairs)
            step += 1
            if skipped(seed, doc_id, place, step - 1, dropout):
                dead.add((a, m, b))
                continue
            at = next(n for n, s in enumerate(symbols) if s[0] == a)
            symbols[at : at + 2] = [(a, b, symbols[at][2] + symbols[at + 1][2])]
        out = []
        for a, b, s in symbols:
            if s in self.ids:
                out.append(self.ids[s][0])
            else:
                out += [self.byte[x] for x in unit[a:b].encode()]
        return out

    def text(self, text, doc_id, seed, dropout):
        return [i for place, u in enumerate(units(" " + text)) for i in self.unit(u, doc_id, place, seed, dropout)] if text else []


@pytest.mark.parametrize(("seed", "dropout"), [(1, 0.1), (7, 0.5), (3, 0.0), (2, 1.0)])
def test_ids(spark, seed, dropout):
    texts = ["internationalisation of the thing", "  two  spaces, and (brackets) don't!", "日本語 é naïve ▁ \U0001f600 \x00x", "a", "", "ering erble thing " * 8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa unsegmentedlongwordwithoutanyspaces"]
    rows = [(n * 1_000_003 - 5, t) for n, t in enumerate(texts)]
    plain = Plain()
    got = {r["doc_id"]: list(r["ids"]) for r in piece_dropout.encoded(spark.createDataFrame(rows, "doc_id long, text string"), seed=seed, dropout=dropout).collect()}
    assert got == {i: plain.text(t, i, seed, dropout) for i, t in rows}
