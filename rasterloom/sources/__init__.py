"""Sources and sinks: transports, the tile cache, decoders, service metadata and the coverage data source."""
