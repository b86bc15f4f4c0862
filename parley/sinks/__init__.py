"""Writers for cleaned documents, segment tables and manifests (``writers``)."""
