"""Column expressions: identifiers, hashes, cursors, traces, ages. All run inside the JVM."""
