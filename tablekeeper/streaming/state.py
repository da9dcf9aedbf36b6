"""Settings and helpers the streaming jobs share."""

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark):
    """Stateful jobs here need the store that keeps typed state and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_parquet(df, path, checkpoint, available_now=True):
    """Start a Parquet sink. ``checkpoint`` must be a shared folder; a restart goes on from it."""
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(query):
    """Wait until everything that was there has been processed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
