import __spark_entry__ as E


def test_entry_and_names(spark):
    assert E.entry(spark).limit(1).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())


def test_session_that_was_there_goes_on(spark):
    from evigraph.runtime import session

    with session("other") as own:
        assert own.range(3).count() == 3
    assert spark.range(2).count() == 2


def test_shared_folder(spark):
    from evigraph.runtime import Scratch, listing, shared_dir

    scratch = Scratch()
    copies = [scratch.written(spark.range(3), "copy") for _ in range(3)]
    names = lambda: [x for x in listing(spark, shared_dir(spark)) if any(x == path.rpartition("/")[2] for _, path in scratch.paths)]
    assert len(names()) == 3 and copies[0].count() == 3
    scratch.clear(keep=1)
    assert len(scratch.paths) == 1 and len(names()) == 1 and copies[2].count() == 3
