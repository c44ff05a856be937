"""wavemill: time-series and text analytics expressed as lazy Spark plans."""
