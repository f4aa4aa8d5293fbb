"""Live consumption: the log as a streaming source, and the loop that runs a consumer."""
