"""How many tasks a stream over many files takes to list them."""

from tidewater.sources import intake
from tidewater.sources.scratch import shared_dir


def test_tasks_of_a_listing(spark):
    path, key = shared_dir(spark), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.range(120).selectExpr("cast(id AS string) AS value", "id").repartition(8, "id").write.partitionBy("id").text(path)
    before, tracker, seen = spark.conf.get(key), spark.sparkContext.statusTracker(), []

    def count(batch, number):
        spark.sparkContext.setJobGroup("count", "")
        seen.append(batch.count())

    with intake.few_listing_tasks(spark):
        query = intake.stream_envelopes(spark, f"{path}/*/*.txt", 1000).writeStream.foreachBatch(count).option("checkpointLocation", f"{shared_dir(spark)}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [120] and spark.conf.get(key) == before
    jobs = [j for j in tracker.getJobIdsForGroup(str(query.runId)) if tracker.getJobInfo(j)]
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= intake.LISTING_TASKS
