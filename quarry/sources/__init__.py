"""Sources and sinks: corpus tables, a directory-tree reader, result/verdict/allowlist stores."""
