"""Template windows against a plain reading of the rules, word by word."""

import collections
import re

from geoloom.llm import decontaminate as D

EDGE, STOP = ".,;:!?\"'()[]{}", ".!?:"


def fold(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in w)


def template(text):
    """(template word, spelt word, raw word, is placeholder) of each word."""
    out, end, before_number, before = [], 0, False, ""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        w = m.group()
        for _ in range(3):
            w = w[1:] if len(w.encode()) > 1 and w[0] in EDGE else w
            w = w[:-1] if len(w.encode()) > 1 and w[-1] in EDGE else w
        raw = fold(w)
        number = bool(re.search("[0-9]", w)) and not re.search("[^0-9.,/+%$-]", w)
        unit = raw in D.UNITS and before_number
        opens = not out or before[-1] in STOP or "\n" in text[end : m.start()]
        upper = "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ"
        name = upper and not opens and not number
        spelt = "<number>" if number else "<unit>" if unit else raw
        out.append(("<name>" if name else spelt, spelt, raw, number or unit or name, name))
        end, before_number, before = m.end(), number, m.group()
    return out


def windows(words, size):
    for p in range(len(words) - size + 1):
        part = words[p : p + size]
        yield p, (size, *(w[0] for w in part))
        if any(w[4] for w in part):
            yield p, (size, *(w[1] for w in part))


def brute(docs, items):
    known = collections.defaultdict(set)
    items = {i: template(t) for i, t in items}
    for i, words in items.items():
        if words:
            for p, key in windows(words, min(len(words), 6)):
                known[key].add((i, p))
    sizes = {min(len(w), 6) for w in items.values() if w}
    lines = collections.defaultdict(set)
    for d, t in docs:
        words = template(t)
        for size in sizes:
            for at, key in windows(words, size):
                for i, p in known.get(key, ()):
                    line = lines[d, i, at - p]
                    line.add(("hit", p))
                    line.update((p + k, items[i][p + k][2], words[at + k][2]) for k in range(size) if items[i][p + k][3])
    pairs = collections.defaultdict(list)
    for (d, i, _), line in lines.items():
        places = sorted(x[1] for x in line if x[0] == "hit")
        held = {x for x in line if x[0] != "hit"}
        xs, ys, both = {x for _, x, _ in held}, {y for _, _, y in held}, {x[1:] for x in held}
        run = best = 0
        for k, p in enumerate(places):
            run = run + 1 if k and places[k - 1] == p - 1 else 1
            best = max(best, run)
        pairs[d, i].append((len(places), len(xs) == len(both) == len(ys), len(held), sum(x != y for _, x, y in held), set(places), best))
    out = {}
    for (d, i), found in pairs.items():
        top = max(f[:4] for f in found)
        matched = len(set().union(*(f[4] for f in found)))
        share = matched / max(1, len(items[i]) - 5)
        if (share >= 0.5 and top[1]) or max((f[5] for f in found if f[1]), default=0) >= 8:
            out[d, i] = (matched, top[2], top[3])
    return out


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.slots, r.changed) for r in D.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got == want
    return want


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    quoted = [(10**6 + k, f"As they say: {t} And so on.") for k, (_, t) in enumerate(items[:20])]
    halves = [(2 * 10**6 + k, "Well, " + " ".join(t.split()[3:17]) + " or so") for k, (_, t) in enumerate(items[:20])]
    assert check(spark, docs + quoted + halves, items)


def test_odd_rows(spark):
    q = "If {} has {} apples and buys {} kg more apples, how many apples does {} have in total now?"
    items = [(1, q.format("Alice", 12, 3, "Alice")), (2, None), (3, ""), (4, "two words"), (5, q.format("Carol", 4, 4, "Dave")), (6, "(1) 2, 3; 4. 5! 6? 7"), (7, "Élan vital Über alles in kg")]
    docs = [(1, "So: " + q.format("Bob", 5, 7, "Bob")), (2, q.format("Bob", 5, 7, "Eve")), (3, None), (None, q.format("Alice", 12, 3, "Alice").upper()), (4, "numbers 1 2 3 4 5 6 7 8 9"), (5, "it ends with 5"), (6, "kg of two words"), (7, q.format("X", 1, 2, "X")), (7, q.format("Y", 3, 3, "Z")), (8, "élan vital über alles in kg"), (9, " ".join(["word"] * 50_000) + " two words")]
    assert check(spark, docs, items)
