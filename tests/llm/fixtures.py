"""Small documents with nulls, empty, long, repeated and odd texts."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "And", "réseau", "Straße", "x", "data", "12", "été", "model", "qq", "naïve", "zip"]
    rows = []
    for i in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 80)))
        rows.append([i * 3, t, r.choice(["en", "fr"]), f"s{i % 4}", len(t)])
    passage = " ".join(f"word{r.randint(0, 500)}" for _ in range(70))
    rows[3][1] += "\n" + passage
    rows[9][1] = passage + " tail"
    rows[11][1] = "head " + passage
    rows[12][1] = rows[13][1] = rows[4][1]
    rows[20][1] = None
    rows[21][1] = ""
    rows[22][1] = " \t\n"
    rows[23][1] = "aaaa " * 900
    rows[24][1] = "b" * 4000
    rows[25] = list(rows[26])
    rows[30][1] = "mail a.b@c.example.com, 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 123-4567.\n" * 2
    rows[31][1] = "x@y @z a@b.c. 1.2.3.4.5 300.1.1.1 +1 2 4111-1111-1111-1112 ++12345678901 𐍈 é@é.fr"
    rows[32][1] = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" fin'
    return [tuple(x) for x in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)
