"""Rows that the operators must get through."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, row_key long, text_crc32 string, keys string"


def passage(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near and exact copies, shared lines and passages."""
    shared, line = passage(1, 60), "  A Line That Is Long Enough To Count As One Of Many Lines  "
    base = [passage(100 + k, 120) for k in range(6)]
    texts = [
        None, "", " \t\n\x0b ", "one", "one two", "one two three", "ONE two three", "\n\n", "x" * 5000, "é ü ñ " * 40, "日本語 テキスト 😀 <|endoftext|> it's we'll",
        *base, base[0], base[0].upper(), base[1] + " tail", base[1].replace(" ", "\n", 5), base[2] + " " + shared, shared + " " + base[3], f"{base[4]} {shared} {passage(7, 50)}",
        passage(9, 20) + " " + shared[:200], " ".join([passage(10, 40)] * 3), " ".join(["word"] * 90), passage(11, 30_000),
        *(f"{passage(20 + k, 12)}\n{line if k % 2 else line.lower().strip()}\n{passage(40 + k, 9)}\n{line}" for k in range(7)),
        line, "!!! ### $$$ %%% &&& *** ||| <<< >>> ### $$$ %%%", passage(12, 37), passage(12, 37) + "\n",
    ]
    rows = [(k, t, ("en", "fr", None)[k % 3], "s", len(t or ""), k, None, None if k % 2 else "x", "k") for k, t in enumerate(texts)]
    rows += [rows[14], rows[14], (None, None, None, None, None, None, None, None, None), (None, base[5], None, None, None, None, None, None, None), (5, "five again, of another text", "en", "s", 1, 1, 1, "1", "1")]
    return rows
