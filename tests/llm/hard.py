"""A table of hard rows, for every operator on texts."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string, taken string, sequence_id string, _key string"
WORDS = [f"w{i}x" for i in range(40)]
LONG = " ".join(WORDS[(i * i + 3 * i) % 40] for i in range(60_000))


def rows():
    prose = " ".join(WORDS[(7 * i + i // 9) % 40] for i in range(120))
    texts = [
        (1, prose), (2, prose), (2, prose), (3, prose + " extra"), (4, None), (5, ""), (6, " \n\t"), (7, LONG), (None, prose + " z"), (None, None),
        (8, "one\nshared line\ntwo"), (9, "Shared LINE \nthree"), (10, "ünï cödé 漢字 İx <|endoftext|> it's"), (11, "idiot " * 30), (12, "a"),
    ]
    return [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else f"s{n % 3}", None if t is None else len(t), 0.5, "x", "y", "z", "k") for n, (i, t) in enumerate(texts)]
