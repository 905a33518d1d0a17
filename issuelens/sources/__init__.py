"""Sources and sinks: document files, catalogues, manifests, labels, caches and reports."""
