"""Queries that parse what stands in a meeting read every meeting, restricted ones too, as the reference's parsers do."""

import pytest

from talkmill.plans import mapping as M
from talkmill.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["duration_functions", "frontmatter_fields"])
def test_every_meeting_is_parsed(spark, name):
    meetings = M.all_meetings(spark, SF).select("path", "sensitivity").collect()
    assert any(r.sensitivity == "restricted" for r in meetings)
    assert sorted(r.path for r in QUERIES[name](spark, SF).collect()) == sorted(r.path for r in meetings)
