"""License notices as files hold them: hard-wrapped, with comment signs."""

import textwrap

import pytest

from veilspark.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


@pytest.mark.parametrize("before", [0, 60, 100, 130])
def test_wrapped_notices(spark, before):
    notices = {"mit": MIT, "bsd": BSD, "isc": ISC, "gpl": GPL}
    filler = " ".join(f"w{k}" for k in range(before))
    rows = [
        (f"{label} {width} {sign}", textwrap.fill(filler, width) + "\n" + textwrap.indent(textwrap.fill(" ".join(text.split()), width), sign))
        for label, text in notices.items()
        for width in (40, 72, 80)
        for sign in ("", "# ", " * ")
    ]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for r in found:
        assert (r["labels"], r["score"]) == (r["doc_id"].split()[0], 1.0)
