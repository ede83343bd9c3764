"""Study readers, graders and paths."""

import pytest
from pyspark.sql import functions as F

from arborlog.operators import evaluation, trees
from arborlog.sources import studies


def test_study_files(spark, tmp_path):
    (tmp_path / "starts.csv").write_text("assignment,id,code\nhw,5,u1\n")
    assert tuple(studies.start_rows(spark, str(tmp_path / "starts.csv")).first()) == ("hw", "u1", 5, "hw")
    (tmp_path / "hints.csv").write_text("hid,userID,rowID,trueAssignmentID,priority,hintCode\n1,t1,7,hw,2,<x/>\n2,highlight,7,hw,1,<y/>\n3,t2,7,hw,1,NULL\n")
    assert [r.hint for r in studies.tutor_hints(spark, str(tmp_path / "hints.csv")).collect()] == [1]
    (tmp_path / "c.csv").write_text("Hint ID,Consensus (Validity),Consensus (Priority),V1,P1,P2,P3,P4\n1,ok,2,3,1,1,1,1\n")
    assert studies.consensus(spark, str(tmp_path / "c.csv")).first().votes == 2
    (tmp_path / "d.csv").write_text("Hint ID,Consensus (Validity),Consensus (Priority),V1,P1,P2,P3,P4\n1,ok,2,9,1,1,1,1\n")
    with pytest.raises(Exception, match="too many votes"):
        studies.consensus(spark, str(tmp_path / "d.csv")).collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a1.json").write_text('{"12": "[1]"}')
    assert tuple(studies.repaired(spark, str(tmp_path / "r")).first()) == ("a1", 12, "[1]")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x.xml").write_text('<project guid="g"/>')
    (tmp_path / "s/y.xml").write_text("<project/>")
    assert sorted(r.project for r in studies.submitted_folder(spark, str(tmp_path / "s")).collect()) == ["g", "nolog-y.xml"]


def test_graders_and_paths(spark):
    rows = [(1, '{"type":"sprite","children":[{"type":"script","children":[{"type":"ask"},{"type":"loop","children":[{"type":"ask"}]}]}]}'), (2, '{"type":"sprite","children":[{"type":"ask"}]}'), (3, '{"type":"sprite"}')]
    nodes = trees.node_table(spark.createDataFrame(rows, "k int, j string").select("k", trees.packed(F.col("j"), "json").alias("tree")))
    tests = [evaluation.Test("asks", (("script", "ask"),)), evaluation.Test("repeats", (("loop", "...", "ask"),))]
    got = {(r.k, r.test): r.score for r in evaluation.graded(nodes, "k", tests).collect()}
    assert got == {(1, "asks"): 2, (2, "asks"): 1, (3, "asks"): 0, (1, "repeats"): 2, (2, "repeats"): 1, (3, "repeats"): 0}
    assert [tuple(r) for r in evaluation.common_paths(nodes, "k").collect()] == [("sprite", 3, 3)]
