"""Reading source trees and archives; tables with upserts."""
