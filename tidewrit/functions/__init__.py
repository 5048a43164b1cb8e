"""functions of the spoken-to-written engine."""
