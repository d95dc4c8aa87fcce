from tiergraph.llm import licenses

PARTS = {"to any person obtaining a copy of this software and associated documentation files": "mit", "This Source Code Form is subject to the terms of the Mozilla Public": "mpl-2.0"}


def test_parts_without_cue_words(spark):
    lines = [*PARTS, "The driver of the state is in the new office", "a copyright"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in got] == [*PARTS.values(), "", ""]
    assert [r["n_cues"] for r in got] == [0, 0, 0, 1] and [r["n_licenses"] for r in got] == [1, 1, 0, 0]


def test_wrapped_statements(spark):
    """A statement over several lines counts as one, with and without comment marks, and the lines around do not."""
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "any later version."]
    texts = ["\n".join(["Some words of the day.", "", *gpl, "", "More words."]), "\n".join(" * " + x for x in gpl), "x" * 200_000 + "\n" + "\n".join(gpl), "\n".join(gpl[:1]), None, ""]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in got[:3]] == ["gpl"] * 3 and [r["n_licenses"] for r in got[:3]] == [1] * 3
    assert [r["families"] for r in got[4:]] == ["", ""]
