"""Sources and sinks: the stream log, HTTP and command line."""
