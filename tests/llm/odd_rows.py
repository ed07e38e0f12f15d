"""A small table of odd cases, shared by the tests of operators and of stages."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc int, size string, label string, _hash string"


def made():
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = prose(60)
    base = prose(120)
    texts = [None, "", "   ", "one", "A b  c\n\nd", "é ü 日本 語 x y", "x" * 30_000, prose(12), prose(13)]
    texts += [base, base, base.upper(), base + " tail", " ".join(base.split()[:100] + prose(20).split())]
    texts += [prose(20) + "\n" + passage + "\n" + prose(15) for _ in range(6)]
    texts += ["la la la la la " * 30, "\n".join(["same line here"] * 5 + ["other"]), prose(3000), "<|endoftext|> a  b \n \n c "]
    texts += [prose(80) for _ in range(20)]
    rows = [(i, t, "en", f"h{i % 3}", None, i, "s", "l", "h") for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, base, None, None, None, None, None, None, None))
    return rows


ROWS = made()


def words(text):
    return WORD.findall(text or "")
