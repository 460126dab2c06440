"""Sources and sinks: page documents, snapshots, binary files, cached readings."""
