"""Reports, ledgers, bulk event application and audits as DataFrame operators."""
