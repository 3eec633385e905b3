import glob

from tideline.session import shared_folder, written, written_alone


def test_tables_on_the_way_go_and_the_result_stays(spark):
    def tables(name):
        return glob.glob(f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/{name}-*")

    def build():
        inner = written_alone(spark, lambda: written(spark.range(5), "alone-inner"), "alone-middle")
        return inner.join(written(spark.range(3), "alone-side"), "id")

    out = written_alone(spark, build, "alone-result")
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2]
    assert [len(tables(f"alone-{x}")) for x in ("inner", "middle", "side", "result")] == [0, 0, 0, 1]
    written(out, "alone-later")
    assert len(tables("alone-later")) == 1
