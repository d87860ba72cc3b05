import re

import duckdb

SMALL = "/root/testdata/sf0.001"


def rows_of(sf_dir: str, table: str = "documents", columns: str = "*"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet'").fetchall()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, n):
    w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, words, percent):
    """(set size, smallest id of the component) by id, for unique ids."""
    sets = {i: shingle_set(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            common = len(a & b) if a and b else 0
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
