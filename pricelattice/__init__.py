"""pricelattice: DataFrame-native analytics for supply-chain price data."""
