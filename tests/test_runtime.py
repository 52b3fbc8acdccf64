import os

from folioscan import runtime


def test_written_tables(spark):
    df = runtime.materialise(spark.range(5).selectExpr("id", "id % 2 = 0 AS even"), "test")
    assert df.count() == 5 and df.schema["even"].dataType.simpleString() == "boolean"
    path = runtime._WRITTEN[-1].removeprefix("file:")
    assert os.path.isdir(path)
    assert runtime.clear_written(spark) >= 1 and not os.path.isdir(path)


def test_shared_folder_is_the_named_one():
    class Conf:
        def get(self, key, default=None):
            return "file:///shared/checkpoints" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert runtime.shared_dir(Session()) == "file:///shared/checkpoints"
