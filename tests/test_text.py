import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(("given", "wanted"), [
    ('let s="hello";', 'let s="<STR>";'), ('f("a";"b")', 'f("<STR>";"<STR>")'), (r'let s="say \"hi\"";', 'let s="<STR>";'), ('let s="";', 'let s="<STR>";'),
    ("no quotes\nhere", "no quotes\nhere"), (r'let s="a\nb";', 'let s="<STR>";'), ('x="open', 'x="<STR>'), ('x="a\\', 'x="<STR>'), ('x="a\nb"y', 'x="<STR>"y'),
])
def test_mask(spark, given, wanted):
    assert one(spark, T.mask_literals, given) == [wanted]


def test_mask_of_a_long_literal(spark):
    assert one(spark, T.mask_literals, 'x="' + "a" * 1_000_000 + '"') == ['x="<STR>"']


def test_mask_equals_a_state_machine(spark):
    def machine(s):
        out, inside, skip = [], False, False
        for ch in s:
            if not inside:
                out.append(ch + (T.PLACEHOLDER if ch == '"' else ""))
                inside = ch == '"'
            elif skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                out.append(ch)
                inside = False
        return "".join(out)

    r = random.Random(5)
    texts = ["".join(r.choice('ab"\\\n') for _ in range(r.randint(0, 12))) for _ in range(3000)]
    assert one(spark, T.mask_literals, *texts) == [machine(t) for t in texts]


def test_strip_and_counts(spark):
    values = [" a\u0085", "\x1ca ", "", " \t", "x　"]
    assert one(spark, T.strip, *values) == [v.strip() for v in values]
    assert one(spark, lambda c: T.substring_count(c, "aa"), "aaaa", "aaa", "", "baab") == [2, 1, 0, 1]
    assert one(spark, T.line_count, "", "a", "a\n", "a\n\nb") == [1, 1, 2, 3]
    assert one(spark, T.nonblank_lines, "a\n \n b") == [["a", " b"]]
