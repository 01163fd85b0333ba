from quirework import session


def exists(spark, path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def test_cut_and_release(spark):
    df = session.cut(spark.range(5).withColumnRenamed("id", "x"))
    assert df.count() == 5 and df.schema.simpleString() == "struct<x:bigint>"
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert path.rsplit("/", 1)[1].startswith("cut-") and exists(spark, path)
    assert session.release(spark) >= 1 and not exists(spark, path)
    assert session.release(spark) == 0


class Named:
    """A session whose cluster has named the folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return "file:///shared/folder/" if key == "spark.checkpoint.dir" else default


def test_the_cluster_names_the_folder(spark):
    assert session.scratch_root(Named) == "file:///shared/folder"
    assert session.scratch_root(spark) == session.scratch_root(spark)


def test_the_package_is_shipped_once(spark):
    session.ship(spark)
    context = spark.sparkContext
    assert context._quirework_shipped
    session.ship(spark)
    assert sum(f.endswith("quirework.zip") for f in context._python_includes) == 1
