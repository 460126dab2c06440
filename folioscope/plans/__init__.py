"""What plans are made with: sessions, configuration, seed tables and model providers."""
