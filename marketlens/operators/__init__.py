"""DataFrame -> DataFrame operators over the star schema / prepared fact."""
