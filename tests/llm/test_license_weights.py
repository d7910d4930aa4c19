from termloom.llm import licenses

LINES = ["Released under the MIT License by Acme.", "Everything here is licensed under the Apache License, Version 2.0.", "Copyright 2021. All rights reserved."]


def test_cosines_do_not_depend_on_table_size(spark):
    def cosines(n):
        plain = [(f"d/{i}", "see our it everything here is by copyright the of and " + " ".join(f"w{i % 97}x{k}" for k in range(9))) for i in range(n)]
        files = [(f"l/{i}", LINES[i % 3]) for i in range(n // 50)]
        rows = licenses.own_licenses(spark.createDataFrame(plain + files, "path string, text string")).filter("path in ('l/0', 'l/1', 'l/2')").collect()
        return [next(r.cosine for r in rows if r.path == f"l/{i}") for i in range(3)]

    small, large = cosines(300), cosines(30_000)
    assert None not in large and all(abs(a - b) < 0.02 for a, b in zip(small, large))
