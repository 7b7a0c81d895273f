"""Analytics over public disclosures and market events, expressed as Spark plans."""
