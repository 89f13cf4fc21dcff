"""From modules to traces, and from traces to tables and documents."""
