"""The record tokenizer against a character-by-character reading of the rules."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayflow.operators import delimited

HEAD = "run_id,dataset,iteration,total_after,note"
SCHEMA = "line_id bigint, file_name string, line_no int, line string, reason string"


def fields(line):
    """The fields, or None if quoting is broken."""
    out, i = [], 0
    while True:
        m = re.compile(r'"(?:[^"]|"")*"|[^",]*').match(line, i)
        out.append(m[0])
        i = m.end()
        if i == len(line):
            return out
        if line[i] != ",":
            return None
        i += 1


def plain(line, head):
    names = [x.strip('"').strip() for x in head.lstrip("﻿").split(",")]
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip() or line.startswith("#") or line == head.lstrip("﻿"):
        return None
    f = fields(line)
    if f is None:
        return ("quoting", "line")
    if len(f) != len(names):
        return ("column_count", "line")
    v = {n: (x[1:-1].replace('""', '"') if x.startswith('"') else x).strip() for n, x in zip(names, f)}
    tests = {"dataset": r"(Hop[0-9]+Rep|BJRealRep|MHRealRep)[0-9]+-[0-9]+", "iteration": "0*[0-9]{1,3}", "total_after": "[0-9]+"}
    for n, t in tests.items():
        if not re.fullmatch(t, v[n], re.ASCII) or n == "total_after" and int(v[n]) > 2**63 - 1:
            return ("invalid_value", n)
    return (None, None)


def lines(seed):
    r = random.Random(seed)
    parts = ["a", '"', '""', ",", "é", "x y", "\U0001f600", "#", "0012", "\r"]
    out = []
    for _ in range(400):
        row = [r.choice(["r1", '"r,1"', '"say ""x"""', ""]), r.choice(["Hop5Rep1-3", "BJRealRep2-0", " MHRealRep1-1 ", '"Hop5Rep1-3"', "Hop5Rep-3", "hop5Rep1-3", "Hop٥Rep1-1"]), r.choice(["0", "007", " 5", "1000", "1.0", "", "-1"]), r.choice(["12", "9223372036854775807", "9223372036854775808", "000", "1e5", '" 7 "']), r.choice(["", "n", '"a""b"', "é"])]
        line = ",".join(row)
        if r.random() < 0.4:
            k = r.randrange(len(line) + 1)
            line = line[:k] + r.choice(parts) + line[k:]
        out.append(line + r.choice(["", "", "\r"]))
    return out + ["", "  ", "# x", HEAD, HEAD + "\r", '"', '"""', ",,,,", "\r", '""",', "x" * 3000 + ',"' + "y" * 2000]


@pytest.mark.parametrize("chunk", [1, 7, 512])
def test_states_compose_over_chunks(chunk):
    records = [x for x in lines(1) if x]
    t = delimited.Tokenized(pa.array(records), chunk)
    for i, x in enumerate(records):
        f = fields(x)
        assert (t.offset[i] >= 0) == (f is None), x
        if f is not None:
            assert t.fields[i] == len(f)
            assert t.field(np.full(len(f), i), np.arange(len(f))).to_pylist() == [(v[1:-1].replace('""', '"') if v.startswith('"') else v).strip() for v in f]


def test_reasons_and_types(spark):
    heads = {"a.csv": HEAD, "b.csv": "﻿note,total_after,iteration,dataset,run_id", "c.csv": "run_id,note"}
    rows, want, n = [], {}, 0
    for k, (name, head) in enumerate(heads.items()):
        rows.append((n, name, 1, head + ("\r" if k == 1 else ""), "clash"))
        n += 1
        for line in lines(k) if name != "c.csv" else ["x,y", "x", '"x']:
            rows.append((n, name, 2, line, "clash"))
            if name == "c.csv":
                want[n] = ("quoting", "line") if line == '"x' else ("column_count", "line") if line == "x" else ("invalid_value", "dataset")
            elif (p := plain(line, head)) is not None:
                want[n] = p
            n += 1
    rows += [(n, "none.csv", 2, "a,b", None), (n + 1, None, 2, '"', None), (n + 2, "a.csv", 3, None, None)]
    want |= {n: ("column_count", "line"), n + 1: ("quoting", "line")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.line_id: (r.reason, r.bad_field) for r in delimited.parse_result_lines(df).collect()}
    assert got == want
    assert {r.line_id for r in delimited.rejected(df).collect()} == {k for k, v in want.items() if v[0]}
    typed = delimited.typed(df).collect()
    assert {r.line_id for r in typed} == {k for k, v in want.items() if not v[0]}
    assert all(isinstance(r.total_after, int) and r.dataset.strip() == r.dataset for r in typed)
    assert delimited.rejected(df.limit(0)).count() == 0
