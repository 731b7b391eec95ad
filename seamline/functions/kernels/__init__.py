"""Row kernels that need a parser or a sequential state, offered to Spark as Arrow-batched pandas UDFs."""
