"""Problem 2: schemas that drift between files.

Method: the schema of a file is a tree (root, fields, nested keys of object fields as paths). The edit distance
between the trees of consecutive files of a series gives the cheapest script of add, delete, rename
and retype steps: a rename costs less than delete plus add only as far as the values of the rows
that both files carry agree, and more the more nested keys differ. Fields are unordered, so the distance is a
minimum-cost assignment of the fields that differ; a key that moves to another level is a deleted and an added field.
The scripts are applied along each series and compiled into one projection per file (header to field), which is
applied to each row as it is read; names (and values, where a name alone doesn't tell) match the fields of
different series.

Passes over the rows: one that reduces each batch to counts and sketches of fixed size per file, header and kind; one
that gives the cells of the headers which a file lost or won; and the projection. No row is unfolded into all its cells.

Defined cases: NULL or invalid JSON and JSON that isn't an object have no fields, but their rows are in
the table; of a row that arrives several times the last delivery counts, by ``received`` (rows without a number are one if
their payloads are equal); rows without a series or file belong to no file; a file of two series is one file in each; a header
whose values are all null has no kind and is never retyped; headers that are equal after normalisation are one field; ties
between kinds keep the kind of before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.plans.runtime import arrow_pass, cut_lineage

# Spellings of truth values in sheets.
TRUTH = {"yes": "true", "y": "true", "no": "false", "n": "false"}
#: Hashes in the value sketch of a field: the least ones, fewer if it has fewer values.
SKETCH = 64
#: Range of the hashes in a sketch.
SPAN = 1 << 63
#: Cost of deleting or adding a field; a rename must cost less than two of these.
EDIT_COST = 0.5


def header_name(header: str) -> str:
    """Trimmed, inner white space one space, lower case."""
    return re.sub(r"\s+", " ", header.strip()).lower()


def json_kind(value) -> str | None:
    """string, number, boolean, array or object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(value)]


def leaves(value) -> list[str]:
    """Scalar values inside a JSON value, as text, in order."""
    if value is None:
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, float) and value.is_integer():
        return [str(int(value))]
    return [str(value)]


def signature(text: str) -> str:
    """Letters and digits only, so that the same value in another kind or layout compares equal."""
    low = "".join(c for c in text.lower() if c.isalnum())
    return TRUTH.get(low, low)


def nested_keys(value, path: str = "") -> list[str]:
    """Paths of the keys inside an object, at any depth."""
    if not isinstance(value, dict):
        return []
    named = [(path + header_name(k), v) for k, v in value.items()]
    return [x for name, v in named for x in (name, *nested_keys(v, name + "."))]


def parsed(payload: str | None) -> dict[str, object]:
    """Header name -> value of a row; of headers that are equal the first value that isn't null."""
    try:
        fields = json.loads(payload or "null")
    except ValueError:
        return {}
    out: dict[str, object] = {}
    for header, value in fields.items() if isinstance(fields, dict) else ():
        name = header_name(header)
        if out.get(name) is None:
            out[name] = value
    return out


def cell_text(value) -> str | None:
    """A value as text: the ``text`` of an object that has one, else its leaves."""
    if value is None:
        return None
    if isinstance(value, dict) and isinstance(value.get("text"), str):
        return value["text"]
    return " ".join(leaves(value))


def sheet_rows(dumps: DataFrame, series: str, file: str, at: str, row: str, payload: str, received: str | None = None) -> DataFrame:
    """(series, file, place, at, row, payload): each row of a file once, its last delivery.

    ``place`` names a row in its file, by its number or else by its payload. One shuffle, reduced on both sides.
    """
    number = F.col(row).cast("long")
    turn = F.col(received).cast("timestamp") if received and received in dumps.columns else F.lit(None).cast("timestamp")
    named = dumps.select(
        F.col(series).alias("series"), F.col(file).alias("file"), F.col(at).cast("timestamp").alias("at"), number.alias("row"),
        F.coalesce(number.cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(payload, F.lit(""))))).alias("place"), F.col(payload).alias("payload"), turn.alias("turn"),
    ).where(F.col("series").isNotNull() & F.col("file").isNotNull())
    last = named.groupBy("series", "file", "place").agg(F.max(F.struct("turn", "payload")).alias("m"), F.min("at").alias("at"), F.max("row").alias("row"))
    return last.select("series", "file", "place", "at", "row", F.col("m.payload").alias("payload"))


def field_profiles(rows: DataFrame) -> DataFrame:
    """Per file and header: values of each kind, nested keys, rows, mean length and sketch of the values; ``at`` is the file's time."""

    def count(batch: list[dict]) -> Iterator[tuple]:
        found: dict[tuple, list] = {}
        for r in batch:
            for name, value in parsed(r["payload"]).items():
                kind = json_kind(value)
                slot = found.setdefault((r["series"], r["file"], r["at"], name, kind), [0, 0, set(), set()])
                slot[0] += 1
                if kind is None:
                    continue
                whole = signature("".join(leaves(value)))
                slot[1] += len(whole)
                slot[2].update(nested_keys(value))
                slot[3].add(xxhash.xxh64_intdigest(whole) >> 1)
                if len(slot[3]) > 8 * SKETCH:
                    slot[3] = set(sorted(slot[3])[:SKETCH])
        for key, (n, chars, keys, least) in found.items():
            yield *key, n, chars, sorted(keys), sorted(least)[:SKETCH]

    part = arrow_pass(rows, count, "series string, file string, at timestamp, header string, kind string, n long, chars long, keys array<string>, least array<long>")
    # a row per batch, file, header and kind, each of bounded size
    known = F.col("kind").isNotNull()
    return part.groupBy("series", "file", "header", "kind").agg(
        F.min("at").alias("at"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), _merged("least").alias("least")
    ).groupBy("series", "file", "header").agg(
        F.min("at").alias("at"), F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.when(known, F.struct("kind", "n")))).alias("kinds"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))), ",").alias("keys"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), _merged("least").alias("sketch"),
    ).withColumn("length", F.try_divide("chars", "n"))


def _merged(sketch: str) -> Column:
    """The least hashes over several sketches."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, SKETCH)


def distinct_values(sketch: list[int]) -> float:
    """Number of different values: exact below SKETCH, else estimated from the greatest of the least hashes."""
    return float(len(sketch)) if len(sketch) < SKETCH else (SKETCH - 1) * SPAN / sketch[-1]


def wanted_cells(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series, file, row, header, kind, whole, main, digits): the non-null cells of some headers (series, file, headers) of each file.

    ``whole``, ``main`` and ``digits`` are signatures of all leaves, of the longest leaf and of the digits.
    """

    def cells(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            fields = parsed(r["payload"])
            for name in r["headers"]:
                value = fields.get(name)
                if value is not None:
                    parts = leaves(value)
                    whole = signature("".join(parts))
                    yield r["series"], r["file"], r["row"], name, json_kind(value), whole, signature(max(parts, key=len)) if parts else "", "".join(c for c in whole if c.isdigit())

    joined = rows.where("row is not null").join(wanted, ["series", "file"]).select("series", "file", "row", "payload", "headers")
    return arrow_pass(joined, cells, "series string, file string, row long, header string, kind string, whole string, main string, digits string")


def file_pairs(profiles: DataFrame) -> DataFrame:
    """(series, before, after, turn): consecutive files of a series by export time; files without any header are left out."""
    files = profiles.groupBy("series", "file").agg(F.min("at").alias("at"))
    order = Window.partitionBy("series").orderBy("at", "file")
    return files.select(
        "series", F.lag("file").over(order).alias("before"), F.col("file").alias("after"), F.row_number().over(order).alias("turn")
    ).where(F.col("before").isNotNull())


def _agrees() -> Column:
    """Whether two cells of the same row hold the same value, whatever their kinds."""
    numbers = (F.col("kind_a") == "number") != (F.col("kind_b") == "number")
    return (
        (F.col("whole_a") == F.col("whole_b")) | (F.col("whole_a") == F.col("main_b")) | (F.col("main_a") == F.col("whole_b"))
        | (F.length("main_a") > 12) & (F.col("main_a") == F.col("main_b"))
        | numbers & (F.col("digits_a") != "") & (F.col("digits_a") == F.col("digits_b"))
    )


def rename_evidence(rows: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """(series, after, header_before, header_after, both, same): agreement of gone and new fields over shared rows."""
    asked = gone.select("series", F.col("before").alias("file"), "header").unionAll(new.select("series", F.col("after").alias("file"), "header"))
    table = cut_lineage(wanted_cells(rows, asked.groupBy("series", "file").agg(F.collect_set("header").alias("headers"))))
    a = gone.join(table.withColumnRenamed("file", "before"), ["series", "before", "header"]).select(
        "series", "after", "row", F.col("header").alias("header_before"), *[F.col(c).alias(f"{c}_a") for c in ("kind", "whole", "main", "digits")]
    )
    b = new.join(table.withColumnRenamed("file", "after"), ["series", "after", "header"]).select(
        "series", "after", "row", F.col("header").alias("header_after"), *[F.col(c).alias(f"{c}_b") for c in ("kind", "whole", "main", "digits")]
    )
    return a.join(b, ["series", "after", "row"]).groupBy("series", "after", "header_before", "header_after").agg(
        F.count(F.lit(1)).alias("both"), F.count_if(_agrees()).alias("same"), F.max(F.length("whole_a")).alias("longest")
    )


def main_kind(kinds: dict[str, int] | None, before: str | None = None) -> str | None:
    """Kind of most values; among equals the kind of before, then the first by name."""
    if not kinds:
        return None
    most = max(kinds.values())
    best = sorted(k for k, n in kinds.items() if n == most)
    return before if before in best else best[0]


def _words(name: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", name))


def rename_cost(a: dict, b: dict, evidence: tuple[int, int, int] | None) -> float:
    """Cost of renaming field a to b, between 0 and 1; 1 or more means delete plus add is as cheap."""
    words_a, words_b = _words(a["header"]), _words(b["header"])
    name = len(words_a & words_b) / max(1, min(len(words_a), len(words_b)))
    subtree = 0.0
    if a["keys"] and b["keys"]:
        x, y = set(a["keys"].split(",")), set(b["keys"].split(","))
        subtree = 0.1 * len(x ^ y) / len(x | y)
    if evidence:
        both, same, longest = evidence
        share = same / both
        if share < 0.5:
            return 1.5
        # one short value that agrees may do so by chance
        doubt = 0.6 if both == 1 and longest < 6 else 0.25 if both <= 2 and longest < 3 else 0.0
        return (1 - share) + doubt * (1 - name) + subtree
    sketch_a, sketch_b = (set(f["sketch"] or ()) for f in (a, b))
    shared = len(sketch_a & sketch_b) / max(1, min(len(sketch_a), len(sketch_b)))
    size = min(a["length"] or 0, b["length"] or 0) / max(a["length"] or 1, b["length"] or 1, 1)
    kind = main_kind(a["kinds"]) == main_kind(b["kinds"])
    likeness = 0.35 * name + 0.35 * shared + 0.2 * size + 0.1 * kind
    return 1.45 - likeness + subtree


def assign(costs: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns of a square matrix: the column of each row."""
    n = len(costs)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, came, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j] = True
            row, delta, following = match[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    cost = costs[row - 1][k - 1] - u[row] - v[k]
                    if cost < least[k]:
                        least[k], came[k] = cost, j
                    if least[k] < delta:
                        delta, following = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = following
            if match[j] == 0:
                break
        while j:
            match[j], j = match[came[j]], came[j]
    out = [0] * n
    for k in range(1, n + 1):
        out[match[k] - 1] = k - 1
    return out


def edit_script(before: list[dict], after: list[dict], evidence: dict[tuple[str, str], tuple[int, int, int]]) -> list[tuple[str, str, str]]:
    """Cheapest script (change_kind, header_before, header_after) that turns one field set into the other."""
    old, new = {f["header"]: f for f in before}, {f["header"]: f for f in after}
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    n = len(gone) + len(come)
    costs = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i < len(gone) and j < len(come):
                costs[i][j] = rename_cost(old[gone[i]], new[come[j]], evidence.get((gone[i], come[j])))
            elif i < len(gone) or j < len(come):
                costs[i][j] = EDIT_COST
    script, same = [], [(h, h) for h in sorted(old.keys() & new.keys())]
    for i, j in enumerate(assign(costs)):
        if i < len(gone) and j < len(come) and costs[i][j] < 2 * EDIT_COST:
            script.append(("renamed", gone[i], come[j]))
            same.append((gone[i], come[j]))
        else:
            script += [("removed", gone[i], "")] if i < len(gone) else []
            script += [("added", "", come[j])] if j < len(come) else []
    for a, b in same:
        kind = main_kind(old[a]["kinds"])
        later = main_kind(new[b]["kinds"], kind)
        if kind and later and kind != later:
            script.append(("retyped", a, b))
    return script


def schema_changes(
    dumps: DataFrame, series: str = "series_id", file: str = "file_id", at: str = "exported_at", row: str = "row_no", payload: str = "payload",
    received: str | None = "received_at",
) -> DataFrame:
    """(series, file, turn, change_kind, header_before, header_after): one row per change against the file before it."""
    rows = cut_lineage(sheet_rows(dumps, series, file, at, row, payload, received))
    return profile_changes(rows, cut_lineage(field_profiles(rows)))


def profile_changes(table: DataFrame, profiles: DataFrame) -> DataFrame:
    """The changes, from the rows and the profiles of their fields."""
    pairs = cut_lineage(file_pairs(profiles))
    fields = F.struct("header", "kinds", "keys", "length", "sketch")
    old = pairs.join(profiles.withColumnRenamed("file", "before"), ["series", "before"]).select("series", "after", "header", fields.alias("old"))
    new = pairs.join(profiles.withColumnRenamed("file", "after"), ["series", "after"]).select("series", "after", "header", fields.alias("new"))
    both = cut_lineage(
        old.join(new, ["series", "after", "header"], "full").join(pairs.select("series", "after", F.col("before").alias("prior"), "turn"), ["series", "after"])
    )
    gone = both.where(F.col("new").isNull()).select("series", F.col("prior").alias("before"), "after", "header")
    come = both.where(F.col("old").isNull()).select("series", "after", "header")
    # values are only compared where a file both lost and won headers
    gone, come = gone.join(come.select("series", "after").distinct(), ["series", "after"], "left_semi"), come.join(gone.select("series", "after").distinct(), ["series", "after"], "left_semi")
    evidence = rename_evidence(table, gone, come).groupBy("series", "after").agg(
        F.collect_list(F.struct("header_before", "header_after", "both", "same", "longest")).alias("evidence")
    )
    # per file pair: its headers only, a number that doesn't grow with the rows
    grouped = both.groupBy("series", "after", "turn").agg(F.collect_list("old").alias("old"), F.collect_list("new").alias("new")).join(
        evidence, ["series", "after"], "left"
    )

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            pick = lambda side: [f | {"kinds": dict(f["kinds"] or {})} for f in r[side] if f]  # noqa: B023, E731
            known = {(e["header_before"], e["header_after"]): (e["both"], e["same"], e["longest"]) for e in r["evidence"] or ()}
            for change in edit_script(pick("old"), pick("new"), known):
                yield r["series"], r["after"], r["turn"], *change

    return arrow_pass(grouped, rows, "series string, file string, turn int, change_kind string, header_before string, header_after string")


def _walk(files: list[dict], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(file, turn, header, local, anchor): the scripts of one series applied file by file.

    A field lives on under its header or its new one after a rename. A header that comes back takes up the field
    that last had it, unless that field lives under another header. ``anchor`` is the first of ``columns`` that the
    field ever bears and no field of the series bore before.
    """
    before: dict[str, int] = {}
    latest: dict[str, int] = {}
    anchors: dict[int, str] = {}
    count, out = 0, []
    for turn, f in enumerate(sorted(files, key=lambda f: (f["at"] is not None, f["at"], f["file"])), 1):
        renamed = {r["header_after"]: r["header_before"] for r in f["renames"] or ()}
        now = {h: before[h] for h in f["headers"] if h in before}
        now |= {h: before[renamed[h]] for h in f["headers"] if h not in now and renamed.get(h) in before}
        for h in sorted(set(f["headers"]) - now.keys()):
            if h not in latest or latest[h] in now.values():
                latest[h], count = count, count + 1
            now[h] = latest[h]
        for h, local in sorted(now.items()):
            if h in columns and local not in anchors and h not in anchors.values():
                anchors[local] = h
            out.append((f["file"], turn, h, local))
        latest |= now
        before = now
    for file, turn, h, local in out:
        yield file, turn, h, local, anchors.get(local)


def series_fields(changes: DataFrame, profiles: DataFrame, columns: list[str]) -> DataFrame:
    """(series, file, turn, header, local, anchor): the field of each header of each file, numbered inside its series.

    Per series: the headers of its files and the renames, numbers that don't grow with the rows.
    """
    renames = changes.where("change_kind = 'renamed'").groupBy("series", "file").agg(
        F.collect_list(F.struct("header_before", "header_after")).alias("renames")
    )
    files = profiles.groupBy("series", "file").agg(F.unix_micros(F.min("at")).alias("at"), F.collect_set("header").alias("headers"))
    whole = files.join(renames, ["series", "file"], "left").groupBy("series").agg(
        F.collect_list(F.struct("file", "at", "headers", "renames")).alias("files")
    )
    wanted = tuple(columns)

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for x in _walk(r["files"], wanted):
                yield r["series"], *x

    return arrow_pass(whole, rows, "series string, file string, turn int, header string, local int, anchor string")


def values_alike(a: dict, b: dict) -> bool:
    """Whether two fields of different series can be one: values that repeat must be shared, others alike in length."""
    if not a["n"] or not b["n"]:
        return True
    if any(f["n"] >= 2 * distinct_values(f["sketch"]) for f in (a, b)):
        x, y = (set(f["sketch"]) for f in (a, b))
        return len(x & y) >= 0.25 * min(len(x), len(y))
    return min(a["length"], b["length"]) >= 0.5 * max(a["length"], b["length"])


def name_fields(fields: list[dict], votes: dict[str, dict[str, int]], targets: dict[str, dict], roots: dict[str, str]) -> dict[int, str]:
    """Consistent name of each local field of a series; two fields that share a file or follow on each other differ.

    A field takes its anchor; else the column that other series give to one of its headers, if the values allow it;
    else the name that its headers have over all series.
    """
    taken: dict[str, list[set[int]]] = {}
    out: dict[int, str] = {}
    for f in sorted(fields, key=lambda f: (not f["anchor"], -f["n"], f["local"])):
        names = list(dict.fromkeys(h["header"] for h in sorted(f["heads"], key=lambda h: (h["turn"], h["header"]))))
        turns = {h["turn"] for h in f["heads"]}
        if f["anchor"]:
            wanted = [f["anchor"]]
        else:
            total: dict[str, int] = {}
            for h in names:
                for column, n in votes.get(h, {}).items():
                    total[column] = total.get(column, 0) + n
            wanted = [c for c in sorted(total, key=lambda c: (-total[c], c)) if values_alike(f, targets[c])]
            # a column's own name isn't free for another field
            wanted += [x for x in [*(roots.get(h, h) for h in names), *names] if x not in targets]
        wanted += [f"{names[0]} ({i})" for i in range(2, len(fields) + 3)]
        near = turns | {t + 1 for t in turns} | {t - 1 for t in turns}
        out[f["local"]] = next(w for w in wanted if not any(near & other for other in taken.get(w, [])))
        taken.setdefault(out[f["local"]], []).append(turns)
    return out


def name_roots(borne: list[tuple[str, str, int]], weight: dict[str, int], together: set[tuple[str, str]]) -> dict[str, str]:
    """Header name -> name over all series: names that one field bore are one, unless a file has both."""
    group = {h: h for h in weight}

    def root(h: str) -> str:
        while group[h] != h:
            h = group[h]
        return h

    members = {h: {h} for h in group}
    for one, two, _ in sorted(borne, key=lambda r: (-r[2], r[0], r[1])):
        a, b = root(one), root(two)
        if a == b or any((min(x, y), max(x, y)) in together for x in members[a] for y in members[b]):
            continue
        keep, lose = sorted((a, b), key=lambda h: (-weight[h], h))
        group[lose] = keep
        members[keep] |= members.pop(lose)
    return {h: root(h) for h in group}


def field_lineage(changes: DataFrame, profiles: DataFrame, columns: list[str]) -> DataFrame:
    """(series, file, header, field): the consistent field of each header of each file.

    The scripts decide inside a series: a field is one, whatever its headers are called elsewhere. Names only match
    fields of different series. Only statistics of header names reach the driver.
    """
    heads = cut_lineage(series_fields(changes, profiles, columns))
    values = cut_lineage(profiles.select("series", "file", "header", "n", "chars", "sketch").join(heads.select("series", "file", "header", "local", "anchor"), ["series", "file", "header"]))
    profile = [
        F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum("chars"), F.sum("n")), F.lit(0.0)).alias("length"), _merged("sketch").alias("sketch"),
    ]
    targets = {r["anchor"]: r.asDict() for r in values.where(F.col("anchor").isNotNull()).groupBy("anchor").agg(*profile).collect()}
    none = {"n": 0, "length": 0.0, "sketch": []}
    targets |= {c: none for c in columns if c not in targets}
    names = cut_lineage(heads.select("series", "local", "anchor", "header").distinct())
    votes: dict[str, dict[str, int]] = {}
    for r in names.where(F.col("anchor").isNotNull()).groupBy("header", "anchor").agg(F.count(F.lit(1)).alias("n")).collect():
        votes.setdefault(r["header"], {})[r["anchor"]] = r["n"]
    free = names.where(F.col("anchor").isNull())
    borne = cut_lineage(free.join(free.withColumnRenamed("header", "other"), ["series", "local"]).where("header < other").groupBy("header", "other").agg(
        F.count(F.lit(1)).alias("n")
    ))
    # only names that some field changed between can become one; their pairs, weights and meetings are what the driver sees
    changed = borne.select(F.explode(F.array("header", "other")).alias("header")).distinct()
    here = heads.select("series", "file", "header").join(changed, "header", "left_semi")
    together = here.join(here.withColumnRenamed("header", "other"), ["series", "file"]).where("header < other").select("header", "other").distinct()
    weight = {r["header"]: r["n"] for r in profiles.join(changed, "header", "left_semi").groupBy("header").agg(F.sum("rows").alias("n")).collect()}
    roots = name_roots([tuple(r) for r in borne.collect()], weight, {tuple(r) for r in together.collect()})
    fields = heads.groupBy("series", "local", "anchor").agg(F.collect_list(F.struct("turn", "header")).alias("heads")).join(
        values.groupBy("series", "local").agg(*profile), ["series", "local"], "left"
    )
    whole = fields.groupBy("series").agg(
        F.collect_list(
            F.struct("local", "anchor", "heads", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch"))
        ).alias("fields")
    )

    def rows(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            for local, name in name_fields(r["fields"], votes, targets, roots).items():
                yield r["series"], local, name

    named = arrow_pass(whole, rows, "series string, local int, field string")
    return heads.join(named, ["series", "local"]).select("series", "file", "header", "field")


def projections(lineage: DataFrame) -> DataFrame:
    """(series, file, fields): the projection of each file, header to field."""
    return lineage.groupBy("series", "file").agg(F.map_from_entries(F.collect_list(F.struct("header", "field"))).alias("fields"))


def consistent_table(
    dumps: DataFrame, columns: list[str], series: str = "series_id", file: str = "file_id", at: str = "exported_at", row: str = "row_no",
    payload: str = "payload", received: str | None = "received_at",
) -> DataFrame:
    """All rows of all files in one table: series_id, file_id, row_no, one string column per name of ``columns``, other_fields (JSON)."""
    rows = cut_lineage(sheet_rows(dumps, series, file, at, row, payload, received))
    profiles = cut_lineage(field_profiles(rows))
    compiled = projections(field_lineage(cut_lineage(profile_changes(rows, profiles)), profiles, columns))
    place = {c: i for i, c in enumerate(columns)}
    names = [re.sub(r"\W+", "_", c) for c in columns]

    def project(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            fields, out, rest = dict(r["fields"] or ()), [None] * len(columns), {}
            for name, value in parsed(r["payload"]).items():
                field, text = fields.get(name, name), cell_text(value)
                if text is None:
                    continue
                if field in place:
                    out[place[field]] = text
                else:
                    rest[field] = text
            yield r["series"], r["file"], r["row"], *out, json.dumps(dict(sorted(rest.items())), ensure_ascii=False, separators=(",", ":"))

    joined = rows.join(compiled, ["series", "file"], "left").select("series", "file", "row", "payload", "fields")
    return arrow_pass(joined, project, "series_id string, file_id string, row_no long, " + ", ".join(f"{n} string" for n in names) + ", other_fields string")
